"""Dimension tables out of manifests, markdown documents and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline import values as V


def read_corpus(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(path, content) of all files below a folder with a name suffix."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


#: Longest text of a bundle that is read back; the limit of a row, not that of the JSON reader.
MAX_TEXT = (1 << 31) - 1


def write_bundles(files: DataFrame, root: str, by: Sequence[str] = ()) -> None:
    """Writes (path, content) rows below a folder as bundles: JSON lines with many small files each.

    A task writes one bundle per value of ``by``, so bundles and folders grow with the bytes and not with the files.
    """
    files.select("path", "content", *by).write.partitionBy(*by).json(root)


def read_bundles(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """(path, content) of all files in the bundles below a folder; a line that is no such file is an error."""
    reader = spark.read.schema("path string, content string").option("mode", "FAILFAST").option("maxStringLen", MAX_TEXT)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(root)


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files below a folder."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
    )


def reference_ids(files: DataFrame, suffix: str = ".md") -> DataFrame:
    """(id, body) of reference outputs: base name without the suffix."""
    name = F.substring_index("path", "/", -1)
    return files.filter(name.endswith(suffix)).select(
        F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("id"), F.col("content").alias("body")
    )


# --- manifests ------------------------------------------------------------------------------------------

def corpus_dim(files: DataFrame) -> DataFrame:
    """(bylaw_id, path) out of manifest file rows (path, bylaw_ids)."""
    return files.select(F.explode("bylaw_ids").alias("bylaw_id"), "path")


def duplicate_keys(dim: DataFrame, *keys: str) -> DataFrame:
    """Keys that appear more than once: an error for a keyed document."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique(dim: DataFrame, *keys: str) -> DataFrame:
    first = duplicate_keys(dim, *keys).first()
    if first is not None:
        raise ValueError(f"duplicate key {[first[k] for k in keys]}")
    return dim


def evidence_entries(documents: DataFrame) -> DataFrame:
    """(domain, bylaw_id, evidence, gap_ids) of both on-disk shapes; ``by_bylaw`` wins over ``entries``.

    ``documents``: domain, json. Merged in long form with a priority, so a key of both shapes keeps one row.
    """
    entry = "map<string,struct<required_evidence_keys:array<string>,expected_gap_ids:array<string>,evidence:array<string>,gap_ids:array<string>>>"
    none = F.array().cast("array<string>")

    def shape(path: str, priority: int, evidence: list[str], gaps: list[str]) -> DataFrame:
        rows = documents.select(
            "domain", F.lit(priority).alias("priority"),
            F.explode(F.from_json(F.get_json_object("json", path), entry)).alias("bylaw_id", "e"),
        )
        return rows.select(
            "domain", "priority", "bylaw_id",
            F.coalesce(*[F.col(f"e.{n}") for n in evidence], none).alias("evidence"),
            F.coalesce(*[F.col(f"e.{n}") for n in gaps], none).alias("gap_ids"),
        )

    both = shape("$.entries", 1, ["required_evidence_keys", "evidence"], ["expected_gap_ids", "gap_ids"]).unionByName(
        shape("$.by_bylaw", 2, ["evidence"], ["gap_ids"])
    )
    return both.groupBy("domain", "bylaw_id").agg(
        F.max_by(F.struct("evidence", "gap_ids"), "priority").alias("e")
    ).select("domain", "bylaw_id", "e.*")


def truth_dim(documents: DataFrame) -> DataFrame:
    """(gap_id, proposed_field, required_field, tolerance, unit) of keyed entries. ``documents``: json."""
    entry = "map<string,struct<proposed_field:string,required_field:string,tolerance:double,unit:string>>"
    return documents.select(
        F.explode(F.from_json(F.get_json_object("json", "$.entries"), entry)).alias("gap_id", "e")
    ).select("gap_id", "e.*")


def manifest_split_ids(documents: DataFrame) -> DataFrame:
    """(doc, split, case_id) out of four manifest shapes; the first shape with ids is used per split.

    Shapes: ``$.<split>`` and ``$.splits.<split>`` and ``$.case_ids.<split>`` (an id array, or an object with
    ``case_ids``), then ``$.files[*]`` rows with ``split`` and ``case_ids``. ``documents``: doc, json.
    """
    none = F.array().cast("array<string>")
    ids = lambda node: F.coalesce(
        F.from_json(F.when(node.startswith("["), node), "array<string>"),
        F.from_json(F.get_json_object(F.when(node.startswith("{"), node), "$.case_ids"), "array<string>"), none,
    )
    files = F.coalesce(
        F.from_json(F.get_json_object("json", "$.files"), "array<struct<split:string,case_ids:array<string>>>"),
        F.array().cast("array<struct<split:string,case_ids:array<string>>>"),
    )
    def listed_for(split: str) -> Column:
        own = F.filter(files, lambda f: f["split"] == split)
        return F.flatten(F.transform(own, lambda f: F.coalesce(f["case_ids"], none)))

    per_split = []
    for split in V.SPLITS:
        shapes = [ids(F.get_json_object("json", f"$['{p}']['{split}']" if p else f"$['{split}']")) for p in ("", "splits", "case_ids")]
        found = F.coalesce(*[F.when(F.size(s) > 0, s) for s in shapes], listed_for(split))
        per_split.append(F.struct(F.lit(split).alias("split"), found.alias("ids")))
    return documents.select("doc", F.inline(F.array(*per_split))).select("doc", "split", F.explode("ids").alias("case_id"))


def build_splits(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id rows, count rows): distinct (domain, split, case_id) and zero-filled counts per (domain, split).

    The manifest stays in long form; one document per domain is only made by ``splits_document``.
    """
    ids = cases.select("domain", "split", "case_id").distinct()
    counts = ids.groupBy("domain").agg(*[F.count_if(F.col("split") == s).alias(s) for s in V.SPLITS])
    return ids, counts


def splits_unchanged(current: DataFrame, previous: DataFrame) -> Column:
    """Whether two id tables hold the same rows (then the old timestamp is kept)."""
    keys = ["domain", "split", "case_id"]
    a, b = current.select(*keys), previous.select(*keys)
    differing = a.exceptAll(b).unionByName(b.exceptAll(a))
    return differing.agg(F.count(F.lit(1)) == 0).scalar()


# --- file names and markdown -------------------------------------------------------------------------------

def discover_domains(case_paths: DataFrame, oracle_paths: DataFrame, corpus_paths: DataFrame) -> DataFrame:
    """Distinct domains named by case files, oracle folders and manifest files (each: path)."""
    base = F.substring_index("path", "/", -1)
    grab = lambda column, pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    parts = [
        case_paths.select(grab(base, r"^([a-z0-9-]+)\.(?:train|dev|holdout|gold-holdout)\.jsonl(?:\.age)?$").alias("domain")),
        oracle_paths.select(grab(F.col("path"), r"(?:^|/)policy-corpus/oracle/([a-z0-9-]+)/").alias("domain")),
        corpus_paths.select(grab(base, r"^(?:corpus-manifest|seed-receipt)\.([a-z0-9-]+)\.json$").alias("domain")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("domain").isNotNull()).distinct()


def md_table_ids(documents: DataFrame, any_text: bool = False) -> DataFrame:
    """(doc, position, id): back-ticked first cells of markdown table rows."""
    body = "[^`]+" if any_text else "[a-z0-9-]+"
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\|\s*`(" + body + r")`\s*\|"), F.lit(1))
    return documents.select("doc", F.posexplode(found).alias("position", "id"))


def md_required_sections(documents: DataFrame, leads: dict[str, str]) -> DataFrame:
    """(doc, audience, position, heading): numbered back-ticked items below their section heading.

    ``leads`` maps a heading prefix ("## ...") to an audience; any other "## " heading ends the section.
    The carried section is a window over the lines of one document, which is a bounded text.
    """
    lines = documents.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    audience = F.lit(None).cast("string")
    for lead, name in leads.items():
        audience = F.when(F.col("line").startswith(lead), name).otherwise(audience)
    opens = F.when(F.col("line").startswith("## "), F.coalesce(audience, F.lit("")))
    upto = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    item = F.regexp_extract("line", r"^\s*[0-9]+\.\s+`([^`]+)`", 1)
    heading = F.trim(F.regexp_replace(item, r"^##\s+", ""))
    rows = lines.select("doc", "line_no", F.last(opens, ignorenulls=True).over(upto).alias("audience"), heading.alias("heading"))
    kept = rows.filter((F.col("audience") != "") & (F.col("heading") != ""))
    place = F.row_number().over(W.partitionBy("doc", "audience").orderBy("line_no")) - 1
    return kept.withColumn("position", place).drop("line_no")


def section_ranges(documents: DataFrame) -> DataFrame:
    """(doc, heading, first, last) character ranges of "##" sections; a section ends where the next begins.

    Positions come from splitting at heading starts, so the whole text is walked once.
    """
    pieces = F.split("text", r"(?m)(?=^##\s)")
    rows = documents.select("doc", F.posexplode(pieces).alias("n", "piece"))
    size = F.length("piece")
    end = F.sum(size).over(W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
    heading = F.trim(F.regexp_replace(F.regexp_extract("piece", r"^##\s+(.+?)\s*(?:\n|$)", 1), r"\s+#+\s*$", ""))
    return rows.select(
        "doc", "n", heading.alias("heading"), (end - size).alias("first"), end.alias("last"),
    ).filter(F.col("heading") != "")


def register_rules(documents: DataFrame) -> DataFrame:
    """(doc, rule_id) out of "## Rule: X" headings."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^##\s+Rule:\s+([A-Z0-9_:.-]+)"), F.lit(1))
    return documents.select("doc", F.explode(found).alias("rule_id"))


def oracle_rule_ids(documents: DataFrame) -> DataFrame:
    """(doc, rule_id) out of JSON ``rules[*].id``."""
    rules = F.from_json(F.get_json_object("json", "$.rules"), "array<struct<id:string>>")
    return documents.select("doc", F.explode(F.transform(rules, lambda r: r["id"])).alias("rule_id"))


# --- few-shot rows and reseal ---------------------------------------------------------------------------------

def few_shot_row_issues(rows: DataFrame, owner: str | None = None) -> DataFrame:
    """(doc, line_no, issue) of few-shot lines: bad JSON, missing keys, or an agent other than the owner.

    ``rows``: doc, line_no, line, and ``owner`` when the file belongs to an agent.
    """
    keys = F.json_object_keys("line")
    missing = F.array_except(F.array(*[F.lit(k) for k in V.FEW_SHOT_KEYS]), keys)
    agent = F.get_json_object("line", "$.agent")
    checks = F.when(F.try_parse_json("line").isNull(), F.lit("invalid JSON")).when(keys.isNull(), F.lit("must be a JSON object")).when(
        F.size(missing) > 0, F.concat(F.lit("missing required keys "), F.array_join(missing, ", "))
    )
    if owner:
        checks = checks.when(agent != F.col(owner), F.concat(F.lit("agent is "), agent))
    return rows.filter(F.trim("line") != "").select("doc", "line_no", checks.alias("issue")).filter(F.col("issue").isNotNull())


def reseal_actions(listing: DataFrame, receipt: DataFrame, force: bool = False) -> DataFrame:
    """Action per sealed target: reuse, keep_receipt, missing_clear, seal, refuse or nothing.

    ``listing``: path, clear_sha256 (null: no clear copy), sealed_sha256 (null: no sealed copy);
    ``receipt``: path, plaintext_sha256, ciphertext_sha256.
    """
    c = F.col
    joined = listing.join(receipt.withColumn("listed", F.lit(True)), "path", "full_outer")
    same = (c("plaintext_sha256") == c("clear_sha256")) & (c("ciphertext_sha256") == c("sealed_sha256"))
    action = (
        F.when(c("clear_sha256").isNull() & c("sealed_sha256").isNull(), "nothing")
        .when(c("clear_sha256").isNull() & c("listed").isNotNull(), "keep_receipt")
        .when(c("clear_sha256").isNull(), "missing_clear")
        .when(F.coalesce(same, F.lit(False)), "reuse")
        .when(c("sealed_sha256").isNotNull() & F.lit(not force), "refuse")
        .otherwise("seal")
    )
    return joined.select("path", action.alias("action"))
