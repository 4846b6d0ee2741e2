"""Each stage against brute force on its own input, and the stages together."""

import corpus_pipeline
import pytest

from pagelight.llm.queries import PLANS

from .test_dedup import brute_contained, split

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "digest"]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, lang, s, 1, "x", 2) for i, t, lang, s in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, digest int")
    return frame.cache()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, rows):
    path = tmp_path_factory.mktemp("tables")
    golden = [(1, " ".join(rows[3][1].split()[40:70])), (2, None)]
    spark.createDataFrame(golden, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string").write.parquet(
        f"{path}/documents.parquet")
    return str(path)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(frame):
    return sorted(str(r["doc_id"]) for r in frame.collect())


def test_language_stage(spark, docs, folder, rows):
    kept = stage("language_id")(spark, docs, folder)
    assert kept.columns == COLUMNS
    assert ids(kept) == sorted(str(i) for i, t, *_ in rows if (t or "").strip())


def test_exact_stage(spark, docs, folder, rows):
    seen, want = {}, set()
    for i, t, *_ in rows:
        t = " ".join((t or "").split()) if (t or "").strip() else (" " if t else "")
        seen.setdefault(t, []).append(i)
    for t, group in seen.items():
        want.add((min((i for i in group if i is not None), default=None), t))
    kept = stage("exact_dedup")(spark, docs, folder)
    assert kept.columns == COLUMNS
    assert ids(kept) == sorted(str(i) for i, _ in want)


def similar_groups(rows):
    """Rows in groups of linked shingle sets; a row without words is a group of its own."""
    sets = []
    for _, t, *_ in rows:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for row, g in zip(rows, group):
        out.setdefault(g, []).append(row)
    return list(out.values())


def test_near_stage(spark, docs, folder, rows):
    want = []
    for group in similar_groups(rows):
        first = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        want += [str(r[0]) for r in group if r[:2] == first[:2]]  # a repeated row stays as often as it stands
    kept = stage("near_duplicates")(spark, docs, folder)
    assert kept.columns == COLUMNS and ids(kept) == sorted(want)


def test_decontamination_stage(spark, docs, folder, rows):
    golden = [(1, " ".join(rows[3][1].split()[40:70]))]
    gone = {i for i, *_ in brute_contained([(k, r[1]) for k, r in enumerate(rows)], golden)}
    assert gone
    kept = stage("decontamination")(spark, docs, folder)
    assert kept.columns == COLUMNS and ids(kept) == sorted(str(r[0]) for k, r in enumerate(rows) if k not in gone)


def test_decisions_are_on_rows(spark, folder, rows):
    """A null id does not save a document, and a shared id does not drop one."""
    passage = rows[3][1]
    near = " ".join([*passage.split()[:-1], "changed"])
    given = [(None, passage), (7, passage), (7, "a clean text of the same id with words of its own"), (None, near), (None, "another clean text without any id")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clean = {(7, given[2][1]), (None, given[4][1])}
    assert {(r.doc_id, r.text) for r in stage("decontamination")(spark, frame, folder).collect()} == clean
    assert {(r.doc_id, r.text) for r in stage("near_duplicates")(spark, frame, folder).collect()} == clean | {(7, passage)}


def test_mixing_stage(spark, docs, folder):
    mixed = stage("mixing")(spark, docs, folder)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "size", "source_size", "target", "taken"]
    assert mixed.filter("taken <= 0 OR taken > 2 * size OR text IS NULL").count() == 0 < mixed.count()


def test_run(spark, folder):
    mixed = corpus_pipeline.run(spark, folder)
    assert mixed.count() > 0 and mixed.select("doc_id").distinct().count() >= mixed.count() - 1


def test_empty_documents(spark, docs, folder):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", sorted(PLANS))
def test_queries_run_on_small_tables(spark, name):
    frame = PLANS[name](spark, "/root/testdata/sf0.001")
    table = "pages" if name.startswith("op1_") else "documents"
    got = frame.count()
    if not name.startswith(("op2_", "op11_", "op13_")):  # these have rows of another kind
        assert got == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    assert len(set(frame.columns)) == len(frame.columns)
