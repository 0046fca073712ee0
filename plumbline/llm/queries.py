"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import bpe_decode, bpe_encode
from plumbline.llm.common import documents
from plumbline.llm.decontaminate import contaminated
from plumbline.llm.kneser_ney import FOLDS, quality
from plumbline.llm.language_id import language_id
from plumbline.llm.line_dedup import without_boilerplate
from plumbline.llm.merkle import fold, merkle_manifest, proof_digest
from plumbline.llm.mixing import mix
from plumbline.llm.prefix_trie import prefix_trie
from plumbline.llm.simhash import simhash_components
from plumbline.llm.surrogates import with_surrogates
from plumbline.llm.token_counts import token_counts
from plumbline.llm.token_files import token_files
from plumbline.llm.weighted_sampling import weighted_fingerprints
from plumbline.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


#: Key of the surrogates in the registered query; a real run takes its own from its secrets.
SURROGATE_KEY = "registered query"

BOILERPLATE_SQL = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place
  from documents),
spread as (select trim(line, ' ') as line from lines where trim(line, ' ') <> '' group by 1 having count(distinct source) >= 5)
select doc_id, count(*) as n_lines, count(spread.line) as n_removed,
  sha256(coalesce(string_agg(lines.line, chr(10) order by place) filter (where spread.line is null), '')) as kept_sha256
from lines left join spread on trim(lines.line, ' ') = spread.line
group by doc_id
"""


#: Unsigned crc32 of a column's decimal text, by the bits of the reversed polynomial.
CRC32_SQL = """
xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::bigint)),
    lambda held, i: xor(held // 2, (held % 2) * 3988292384::bigint))), 4294967295::bigint)
"""


PREFIX_TRIE_SQL = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as said
  from conversations where conv_id is not null),
kept as (select conv_id, list(said order by place) as said from turns group by conv_id),
heads as (select *, {CRC32_SQL.format("conv_id")} % 9 as h from kept),
rebuilt as (
  select c.conv_id, coalesce(b.said[1:c.h], []) || c.said[c.h + 1:] as said
  from heads c left join kept b on b.conv_id = c.conv_id - c.conv_id % 5),
prefixes as (
  select conv_id, unnest(range(len(said) + 1)) as depth, len(said) as n, said from rebuilt),
members as (select conv_id, depth, n, said[1:depth] as way from prefixes),
nodes as (
  select way, depth, min(conv_id) as conv_id, count(*) as n_convs,
    (count(*) - 1) * coalesce(strlen(way[depth].text), 0) as saved,
    sha256(coalesce(string_agg(case when n = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from members group by way, depth),
tree as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and c.way[1:n.depth] = n.way) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.way = n.way[1:n.depth - 1] and n.depth > 0),
sums as (
  select t.way, count(*) filter (where b.n_children = 0) as n_leaves, sum(b.saved) as saved_tokens
  from tree t join tree b on b.depth >= t.depth and b.way[1:t.depth] = t.way group by t.way)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from tree join sums on sums.way = tree.way
"""


def _merkle_levels(name: str, keys: str, order: str, levels: int = 7) -> str:
    """Levels of a digest tree in SQL: ``name``_0 (keys, digest, order column) up to the level of single nodes."""
    ctes = [f"{name}_l0 as (select {keys}, row_number() over (partition by {keys} order by {order}) - 1 as place, count(*) over (partition by {keys}) as n, * exclude ({keys}) from {name}_0)"]
    for k in range(1, levels + 1):
        ctes.append(f"""{name}_l{k} as (
  select {keys}, place // 16 as place, (any_value(n) + 15) // 16 as n,
    case when any_value(n) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by place)) end as digest
  from {name}_l{k - 1} group by {keys}, place // 16)""")
    return ",\n".join(ctes)


def _merkle_paths(name: str, keys: str, below: str, levels: int = 7) -> str:
    """For every row of ``below`` (row_no, keys, place, held, siblings): held folded to the top, siblings gathered."""
    ctes = [f"{name}_p0 as (select row_no, {keys}, place, held, siblings from {below})"]
    for k in range(levels):
        ctes.append(f"""{name}_p{k + 1} as (
  select p.row_no, any_value(p.{keys}) as {keys}, any_value(p.place) // 16 as place,
    case when any_value(o.n) = 1 then any_value(p.held) else sha256(string_agg(case when o.place = p.place then p.held else o.digest end, '' order by o.place)) end as held,
    any_value(p.siblings) || coalesce(string_agg(case when o.place <> p.place then o.digest end, '' order by o.place), '') as siblings
  from {name}_p{k} p join {name}_l{k} o on o.{keys} = p.{keys} and o.place // 16 = p.place // 16 group by p.row_no)""")
    return ",\n".join(ctes)


def _merkle_sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*(part(c) for c in ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with t_0 as (
  select coalesce('=' || source, '-') as key, doc_id, row_number() over () as row_no, {leaf("text")} as digest,
    case when {CRC32_SQL.format("doc_id")} % 5 = 0 then {leaf(lower)} else {leaf("text")} end as held, '' as siblings
  from documents),
{_merkle_levels("t", "key", "doc_id nulls first, digest")},
{_merkle_paths("t", "key", "t_l0")},
s_0 as (select 1 as top, key as name, digest from t_l7),
{_merkle_levels("s", "top", "name", 4)},
s_rows as (select t_p7.row_no, 1 as top, s_l0.place, t_p7.held, t_p7.siblings from t_p7 join s_l0 on s_l0.name = t_p7.key),
{_merkle_paths("s", "top", "s_rows", 4)}
select t_l0.doc_id, t_l0.digest as leaf, t_l7.digest as subroot, s_l4.digest as root, sha256(s_p4.siblings) as proof_sha256,
  s_p4.held as folded_root, s_p4.held = s_l4.digest as verified
from t_l0 join t_l7 on t_l7.key = t_l0.key join s_p4 on s_p4.row_no = t_l0.row_no cross join s_l4
"""


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir), SURROGATE_KEY).select("row.doc_id", "n_found", F.col("clean_text").alias("text"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_boilerplate(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = BOILERPLATE_SQL


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("row.doc_id", "row.source", "tokens", "weight", "copies")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), folds=FOLDS)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


@query
def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints(documents(spark, sf_dir))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe_decode(bpe_encode(documents(spark, sf_dir)))
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations")).drop("high", "low", "digest")


ORACLES["op12_prefix_trie"] = PREFIX_TRIE_SQL


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(tampered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    found = merkle_manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], presented={"text": text})
    folded = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("presented"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op13_merkle"] = _merkle_sql()
