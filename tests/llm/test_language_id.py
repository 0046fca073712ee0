from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm.language_id import MAX_LANGUAGES, fit, held_out, language_id, predict
from plumbline.llm.stages import known_language

SYLLABLES = {"aa": "ka to mi ra ne so".split(), "bb": "brun delt frus glim".split(), "cc": "über öst äng ßen".split(), "дд": "при вет мос ква".split()}


def text_in(language: str, seed: int, words: int = 40) -> str:
    pick = random.Random(f"{language}{seed}")
    return " ".join("".join(pick.choice(SYLLABLES[language]) for _ in range(pick.randint(1, 4))) for _ in range(words))


def labelled(n: int = 60):
    return [(text_in(lang, i), lang, "s") for i in range(n) for lang in SYLLABLES]


def test_held_out_accuracy(table):
    rows = labelled()
    docs = table(rows)
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(r.held_out for r in got.values()) > 20
    assert all(got[i].lang_pred == rows[i][1] and got[i].score > 0.9 for i in got)


def test_labels_of_held_out_rows_are_not_used(table):
    rows = labelled()
    turned = [(t, "aa" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, (t, lang, s) in enumerate(rows)]
    pick = lambda rows: sorted(tuple(r) for r in language_id(table(rows)).collect())
    assert pick(rows) == pick(turned)


def test_odd_rows(spark, table, odd_rows):
    rows, ids = odd_rows
    docs = table(rows + labelled(10), ids + list(range(50, 90))).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    got = language_id(docs).collect()
    assert len(got) == docs.count()
    unknown = sorted(r.doc_id for r in got if r.lang_pred == "und")
    assert unknown == [0, 1, 2, 3] and all(0 <= r.score <= 1 for r in got)
    assert language_id(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages_fill_several_words(table):
    pick = random.Random(1)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    own = {f"l{i:03}": [alphabet[4 * i + k] for k in range(4)] for i in range(90)}
    rows = [("".join(pick.choice(own[lang]) for _ in range(40)), lang, "s") for lang in own for _ in range(6)]
    docs = table(rows)
    filters = fit(docs)
    assert len(filters.languages) == 90 <= MAX_LANGUAGES and filters.rows.shape[0] == 2
    assert all(r.lang_pred == r.row.lang for r in predict(docs, filters).collect())


def test_stage_keeps_documents_of_a_language(spark, table):
    docs = table(labelled(20) + [("", "aa", "s"), (None, None, "s"), ("42 + 17", "aa", "s"), ("xqzjw vfhqx wzxqj" * 5, None, "s")])
    kept = known_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))


def test_held_out_of_null(spark):
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(held_out()).first()[0] is False
