"""The pipeline stage by stage: what each keeps, and the whole against a brute-force version of its exact stages."""

from collections import Counter

import corpus_pipeline as p
from docloom.llm.common import table

from .test_operators import brute_decontamination, brute_near, brute_tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kinds, kept, seen = [f.name for f in docs.schema], docs, {}
    for name, stage in p.STAGES:
        kept = stage(spark, kept, SF).cache()
        seen[name] = kept
        if stage is not p.token_stage:
            assert kept.columns == kinds
    rows = lambda n: [(r.doc_id, r.text) for r in seen[n].collect()]
    good, unique, clean, mixed = (rows(n) for n, _ in p.STAGES[:4])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    ids = {i for i, _ in good}
    wanted = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in wanted) >= 0.97 * len(wanted) and sum(i in ids for i, q in labels.items() if q == 0) <= 1
    assert {i for i, _ in unique} == {r[0] for r in brute_near(good) if r[3]}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {i for i, _ in clean} == {r[0] for r in brute_decontamination(unique, items) if not r[5]}
    assert set(Counter(i for i, _ in mixed).values()) <= {1, 2} and {i for i, _ in mixed} <= {i for i, _ in clean}
    out = seen[p.STAGES[4][0]].collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, len(x)) for i, x in brute_tokens(mixed))
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_run_is_the_stages(spark):
    a, b = (sorted(map(tuple, p.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_awkward_rows(spark, docs, empty):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", "label", "_id", "node")
    for rows in (own, own.limit(0)):
        for _, stage in p.STAGES:
            before, rows = rows, stage(spark, rows, SF).cache()
            if stage is not p.token_stage:
                assert rows.columns == own.columns
                texts = lambda df: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())
                assert set(texts(rows)) <= set(texts(before))
        rows.collect()


def test_rows_are_judged_by_themselves(spark):
    """Ids with several texts, null ids, repeated rows: each stage decides by row."""
    items = [r.text for r in table(spark, SF, "benchmark").collect() if r.text and len(r.text.split()) >= 12][:2]
    clean = ["the %s of a plain and quite ordinary sentence that has nothing to do with it, number %d" % (w, k) for k, w in enumerate(("first", "second", "third"))]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)

    rows = [(1, clean[0], "a"), (1, items[0], "a"), (2, items[0], "a"), (None, clean[1], "b"), (None, items[1], "b"), (3, None, "c"), (3, clean[2] + " " + items[1], "c")]
    assert got(p.decontamination_stage(spark, frame(rows), SF)) == sorted([rows[0], rows[3], rows[5]], key=str)

    long = " ".join(f"word{k}" for k in range(60))
    near = long + " more"
    rows = [(5, long, "a"), (5, near, "b"), (5, "quite another text, of its own", "a"), (5, "quite another text, of its own", "a"), (9, near, "a"), (None, long, "z"), (4, "alone with its words here", "a")]
    rows += [(None, "words without an id, in two rows", s) for s in "xy"] + [(None, "and other words without an id", "x"), (7, "", "a"), (8, "", "a"), (8, "", "a"), (8, None, "a"), (None, None, "a")]
    kept = got(p.near_duplicate_stage(spark, frame(rows), SF))
    assert Counter((i, t) for i, t, _ in kept) == Counter([
        (5, next(t for i, t, _ in kept if i == 5 and t in (long, near))), (5, "quite another text, of its own"), (4, "alone with its words here"), (None, "words without an id, in two rows"),
        (None, "and other words without an id"), (7, ""), (8, ""), (8, None), (None, None),
    ])
    assert kept == got(p.near_duplicate_stage(spark, frame(rows[::-1]).repartition(5), SF))

    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in p.quality_stage(spark, docs, SF).collect()}
    good, bad = (next(i for i in sorted(labels) if labels[i] == q and (i in kept) == bool(q) and texts[i]) for q in (1, 0))
    more = spark.createDataFrame([(good, texts[bad]), (None, texts[bad]), (None, texts[good]), (bad, texts[good])], "doc_id long, text string")
    after = Counter((r.doc_id, r.text) for r in p.quality_stage(spark, docs.unionByName(more, allowMissingColumns=True), SF).collect())
    assert after[good, texts[bad]] == after[None, texts[bad]] == after[bad, texts[bad]] == 0
    assert after[None, texts[good]] == after[bad, texts[good]] == after[good, texts[good]] == 1
