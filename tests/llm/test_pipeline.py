"""The pipeline stage by stage against plain rules on the smallest tables."""

import re

import pytest

pytest.importorskip("cutroom.llm")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cutroom.llm import decontaminate, pii  # noqa: E402

SF = "/root/testdata/sf0.001"


def groups(texts, k=5):
    """The least id of each text's group, by all pairs."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[s : s + k]) for s in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return root


LONG = " ".join(f"word{i} und die the" for i in range(3000))
BASE = " ".join(f"the house number {i} of this road" for i in range(12))
ODD = [
    (1, BASE, "en", "a", 5, 1), (1, BASE, "en", "a", 5, 1), (2, BASE, "en", "b", 5, 2), (None, BASE, "en", "c", 5, 3), (3, BASE + " end", "en", "d", 5, 4), (4, None, "en", "e", None, 5), (5, "", None, "f", 0, 6),
    (6, "123 456", "de", "g", 7, 7), (7, LONG, "de", "h", 1, 8), (7, "another text of the same id", "en", "i", 1, 9), (8, "mail me at a.b@example.org please", "en", "j", 2, 10), (None, "no id here", "en", "k", 3, 11),
]


def test_stages_on_odd_rows(spark):
    """Null, empty, very long and repeated texts, ids that are null or repeat, and columns named as the stages' own."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row int"
    docs = spark.createDataFrame(ODD, names).repartition(5)
    for clash in ("score", "_key", "key", "node", "found", "lang_pred"):
        docs = docs.withColumn(clash, F.lit(clash))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    after = stages["language_id"](spark, docs, SF)
    assert after.columns == columns and sorted(r["row"] for r in after.collect()) == [1, 1, 2, 3, 4, 8, 9, 10, 11]
    assert {r.lang_pred for r in after.collect()} == {"lang_pred"}
    after = stages["near_dedup"](spark, docs, SF)
    # one row of each group: the least id of the copies, rows that repeat id and text once; nothing else goes
    assert after.columns == columns and sorted(r["row"] for r in after.collect()) == [1, 5, 6, 7, 8, 9, 10, 11]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    tainted = docs.unionByName(docs.where("row = 9").withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(f"before {item.upper()} after"), "row": F.lit(99)}))
    after = stages["decontaminate"](spark, tainted, SF)
    assert after.columns == columns and sorted(r["row"] for r in after.collect()) == [1, *range(1, 12)]
    after = {r["row"]: r for r in stages["pii"](spark, docs, SF).collect()}
    assert len(after) == 11 and after[5].text is None and after[5].n_chars is None and after[8].text == LONG
    assert after[10].text == pii.redacted("mail me at a.b@example.org please") and "@" not in after[10].text and after[10].n_chars == len(after[10].text)
    found = stages["encode"](spark, docs, SF).collect()
    assert len(found) == len(ODD) and sorted(r.n_tokens for r in found)[:2] == [0, 0] and all(r.n_tokens == len(r["ids"]) for r in found)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "encode":
            assert docs.columns == columns
        seen[name] = (before, after)
        docs = spark.createDataFrame([tuple(r) for r in after.values()], docs.schema)
    before, after = seen["language_id"]
    assert set(after) == {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    before, after = seen["decontaminate"]
    items = [decontaminate.normalised(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(i and i in decontaminate.normalised(t) for i in items)
    assert not any(holds(r.text) for r in after.values())
    before, after = seen["pii"]
    assert set(before) == set(after) and all(r.text == pii.redacted(before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
    before, after = seen["near_dedup"]
    assert set(after) == {i for i, least in groups({i: r.text for i, r in before.items()}).items() if i == least}
    before, after = seen["encode"]
    assert set(before) == set(after) and all(r.n_tokens == len(r["ids"]) > 0 for r in after.values())


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_are_worked_out_once(spark, monkeypatch):
    """run() writes a table between stages: what comes after the first one reads no document again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("text", read.asNondeterministic()("text"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: docs)
    counts = []
    for n in (1, 2, 4):
        monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:n] if n < 4 else [*FIRST[:2], ("same", lambda spark, docs, sf_dir: docs)])
        before = seen.value
        assert corpus_pipeline.run(spark, SF).count() > 0
        counts.append(seen.value - before)
        monkeypatch.setattr(corpus_pipeline, "STAGES", FIRST)
    assert counts[1] == counts[2] <= counts[0] * 2


FIRST = list(corpus_pipeline.STAGES)
