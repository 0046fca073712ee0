"""Plans that put several operators together."""
