"""The registered queries and the pipeline on the smallest tables, stage by stage against brute force."""

import collections
import re

import pytest

import corpus_pipeline
from tablekeeper.llm.queries import QUERIES, table
from tests.llm.test_dedup import SPLIT, alike, groups, low, rows_of, sets_of
from tests.llm.test_search_and_rules import hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [q for q in sorted(QUERIES) if q.split("_")[0] not in ("op10", "op11", "op13")])
def test_query_covers_every_document(spark, name):
    out = QUERIES[name](spark, SF)
    want = collections.Counter(r["doc_id"] for r in table(spark, SF, "documents").collect())
    got = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert set(got) == set(want) and (name.startswith("op3") or got == want)


def test_queries_of_other_rows_cover_their_tables(spark):
    """op13 has every conversation; op11 every source, and the documents of each are those kept or removed in any order."""
    told = [r["conv_id"] for r in QUERIES["op13_conversation_structure_repair"](spark, SF).collect()]
    assert sorted(told) == sorted({r["conv_id"] for r in table(spark, SF, "conversations").collect()})
    size = collections.Counter(r["source"] or "" for r in table(spark, SF, "documents").collect())
    rows = [r for r in QUERIES["op11_filter_interaction_audit"](spark, SF).collect() if r["filter_order"] == "DBEAC"]
    assert {p: sum(r["removed"] for r in rows if r["part"] == p) + next(r["kept"] for r in rows if r["part"] == p and r["step"] == 5) for p in size} == size


@pytest.fixture(scope="module")
def stages(spark):
    from tablekeeper.session import materialize
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        nxt = materialize(stage(spark, docs, SF), "stage-" + name)
        out.append((name, docs, nxt))
        docs = nxt
    return {name: (a, b) for name, a, b in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_in_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination",
                                                      "best_fit_packing"]
    cols = table(spark, SF, "documents").columns
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == cols


def test_classifier_stage(spark, stages):
    before, after = map(texts, stages["quality_classifier"])
    assert all(before[d] == t for d, t in after.items())
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    good = [d in after for d in before if labels.get(d) == (1, 0)]
    assert sum(good) >= 0.95 * len(good)
    assert not any(d in after for d in before if labels.get(d, (1, 0))[1] == 1)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    rows = rows_of(before)
    lines = [(d, k, tuple(SPLIT.findall(low(x)))) for d, t in rows for k, x in enumerate(t.split("\n"))]
    gone, seen = set(), []
    for d, k, w in lines:
        if len(w) >= 4:
            if any(alike(v, w) for v in seen):
                gone.add((d, k))
            seen.append(w)
    want = {}
    for d, t in rows:
        each = t.split("\n")
        if any((d, k) in gone for k in range(len(each))):
            if all((d, k) in gone or not SPLIT.search(x) for k, x in enumerate(each)):
                continue
            t = "\n".join(x for k, x in enumerate(each) if (d, k) not in gone)
        want[d] = t
    assert {d: t or "" for d, t in texts(after).items()} == want
    touched = {d for d, _ in gone}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["doc_id"] in touched)


def test_line_stage_on_repeated_rows_and_null_ids(spark):
    a, b, c, d = ("one two three four five", "six seven eight nine", "ten eleven twelve thirteen", "dog cat cow hen fox")
    rows = [(7, f"{a}\n{b}", "en", 900), (7, f"{a}\n{b}", "en", 901), (7, f"{b}\n{c}", "de", 902), (3, d, "en", 903),
            (None, f"{d}\nown words", "fr", 904), (None, a, "fr", 905), (8, None, None, 906), (9, "", "en", 907), (9, "hi", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1)
    out = corpus_pipeline.dedup_lines(spark, docs, SF)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    want = [(7, f"{a}\n{b}", "en", 900), (7, c, "de", len(c)), (3, d, "en", 903), (None, "own words", "fr", 9),
            (8, None, None, 906), (9, "", "en", 907), (9, "hi", None, None)]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    want = groups(sets_of(rows_of(before), 5))
    assert set(texts(after)) == {d for d, c in want.items() if c == d}


def test_decontamination_stage(spark, stages):
    before, after = map(texts, stages["benchmark_decontamination"])
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    # only documents that share three words in a row with an item can be hit by a window; short items are tried on all
    grams = {tuple(w[i:i + 3]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))] for i in range(len(w) - 2)}
    assert all(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))) >= 3 for _, t in items)
    want = set()
    for d, t in before.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
        if not any(tuple(w[i:i + 3]) in grams for i in range(len(w) - 2)) or not hits(t, items)[4]:
            want.add(d)
    assert set(after) == want and all(before[d] == t for d, t in after.items())


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    assert {r["doc_id"] for r in after.collect()} == set(texts(before))
    by = collections.defaultdict(list)
    for r in after.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024


def test_pipeline_on_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF, t).where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
