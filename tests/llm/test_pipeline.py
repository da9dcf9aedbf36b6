"""The pipeline's stages beside plain definitions on a small table."""

import collections
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tablekeeper.llm import jaccard_join, mixing, pii, toxicity
from tests.llm.test_operators import PLAIN, brute_components, normal, passes, prose, words_of

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        after = spark.createDataFrame(after.collect(), docs.schema)
        old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old)
        if name == "toxicity":
            bad = [i for i, t in labels.items() if t]
            assert sum(i in new for i in bad) <= len(bad) // 4
            assert sum(i not in new for i, t in labels.items() if not t) <= 3
        if name == "near_duplicates":
            groups = jaccard_join.joined(before).collect()
            assert set(new) == {r.component_id for r in groups}
        if name == "personal_data":
            assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in new.values())
            assert all(r.n_chars == len(r.text) for r in new.values())
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert mixed.count() == before.count()
    assert sorted(r.taken for r in mixed.collect()) == sorted(r.taken for r in corpus_pipeline.run(spark, FOLDER).collect())


def plain_toxicity(docs, model):
    weight = dict(zip(model.known.tolist(), model.weights))

    def rejected(text):
        times = collections.Counter(toxicity.features(pa.array([text], pa.string()))[1].tolist())
        score = sum(weight[f] * math.log1p(n) for f, n in times.items() if f in weight)
        return 1 / (1 + math.exp(score - model.thresholds[0])) < 0.5

    return {r for r in docs if not rejected(r.text)}


def plain_near_duplicates(docs):
    docs = sorted(docs, key=lambda r: r.doc_id)
    _, roots = brute_components([r.text for r in docs])
    return {docs[i] for i in set(roots)}


def plain_decontaminate(docs, items):
    windows = collections.defaultdict(set)
    for words in map(normal, items):
        k = min(10, len(words))
        windows[k] |= {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()
    hit = lambda w: any(tuple(w[i:i + k]) in seen for k, seen in windows.items() for i in range(len(w) - k + 1))
    return {r for r in docs if not hit(normal(r.text))}


def plain_personal_data(docs, spans):
    """Spans (start, kind, end) of each id, those that overlap as one, named by the first."""
    out = {}
    for r in docs:
        joined = []
        for s, k, e in sorted(spans[r.doc_id]):
            if joined and joined[-1][2] > s:
                joined[-1][2] = max(joined[-1][2], e)
            else:
                joined.append([s, k, e])
        text, at = "", 0
        for s, k, e in joined:
            text, at = f"{text}{r.text[at:s]}[{pii.KINDS[k].upper()}]", e
        out[r.doc_id] = text + r.text[at:]
    return out


def plain_mix(docs):
    """Words taken of each id."""
    def key(r):
        u = (int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / max(0.1, 1 - 10 * len(re.findall(r"[#*$%&|<>]", r.text)) / max(1, len(r.text)))

    by = collections.defaultdict(list)
    for r in docs:
        by[r.source].append(r)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    size = {s: sum(len(words_of(r.text)) for r in rows) for s, rows in by.items()}
    left, open_, target = 1.5 * sum(size.values()), dict(weight), {}
    while over := [s for s in open_ if left * weight[s] / sum(open_.values()) > 2 * size[s]]:
        target |= {s: 2 * size[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    taken = {}
    for s, rows in by.items():
        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        upto = 0
        for r in sorted(rows, key=lambda r: (key(r), r.doc_id)):
            n = len(words_of(r.text))
            upto += n
            taken[r.doc_id] = n * (epochs + (upto <= target[s] - epochs * size[s]))
    return taken


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        sizes.append(len(rows))
        got = stage(spark, docs, FOLDER).collect()
        if name == "toxicity":
            assert set(got) == plain_toxicity(rows, toxicity.train(docs, labels))
        if name == "near_duplicates":
            assert set(got) == plain_near_duplicates(rows)
        if name == "decontaminate":
            assert set(got) == plain_decontaminate(rows, items)
        if name == "personal_data":
            found = pii.spans(docs, pii.train(docs)).withColumn("base", pii.written("base")).collect()
            for r in found:
                want = sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN)
                              for m in re.finditer(PLAIN[kind], r.text) if passes(kind, m.group()))
                assert r.base == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
                assert {(x.s, x.k, x.e) for x in r.spans} >= set(want)
            spans = {r.doc_id: [(x.s, x.k, x.e) for x in r.spans] for r in found}
            assert {r.doc_id: r.text for r in got} == plain_personal_data(rows, spans)
        if name == "mix":
            assert {r.doc_id: r.taken for r in got} == plain_mix(rows)
            break
        assert len(got) == len({r.doc_id for r in got})
        docs = spark.createDataFrame(got, docs.schema)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]


def test_one_row_of_repeated_documents(spark):
    text = prose(1, 50)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (None, prose(2, 50), "en", "b", 1),
            (3, None, None, None, None), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert pii.redacted(docs, {}).count() == 6 and mixing.mix(docs).count() == 6


def test_groups_are_decided_by_row(spark):
    words = prose(7, 200).split()
    near = " ".join([*words[:-1], "changed"])
    rows = [(1, " ".join(words)), (None, near), (None, " ".join(words)), (2, near),  # one group, id 1 stays
            (None, prose(8, 60)), (None, prose(9, 60)), (None, prose(9, 60)),  # two groups without id
            (5, prose(10, 60)), (5, prose(11, 60)), (5, prose(10, 60)),  # one id, two texts
            (6, prose(11, 60)), (0, prose(12, 60)), (9, prose(12, 60)), (9, prose(13, 60)),
            (None, None), (None, None), (None, " "), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), FOLDER)
    assert kept.schema == docs.schema
    want = [(1, " ".join(words)), (None, prose(8, 60)), (None, prose(9, 60)), (5, prose(10, 60)), (5, prose(11, 60)),
            (0, prose(12, 60)), (9, prose(13, 60)), (None, None), (None, " "), (3, ""), (4, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


#: Names that the operators use for themselves.
CLASHING = ("n_words score p_0 severity grade rejected hits items n_hit n_items items_sha256 contaminated spans base base_email "
            "base_ip more picked _null n_email n_ip kept _kept row _row number doc id component_id n_shingles size taken "
            "target source_size key n line host").split()


def test_stages_carry_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for repeat in (False, True):
        if repeat:
            docs = docs.unionByName(docs.limit(3))
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, FOLDER)
            if name == "mix":
                assert got.count() == docs.count()
                continue
            assert got.schema.names == docs.schema.names and dict(got.dtypes) == dict(docs.dtypes)
            rows = got.collect()
            assert rows
            for r in rows:
                assert [r[c] for c in CLASHING] == [f"{k}-{r.doc_id}" for k in range(len(CLASHING))]


def test_borders_of_uneven_keys(spark, monkeypatch):
    """Sources of low and of mixed quality, cut in several rounds, against sorting each source whole."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    monkeypatch.setattr(mixing, "CUTS", 4)
    symbols = "#" * 40
    texts = [prose(i, 3 + i % 17) + (symbols if i % 3 or i > 300 else "") for i in range(400)] + ["", " ", "one"]
    rows = [(i, t, "en", "hot" if i > 90 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert got == plain_mix(docs.collect())
    seen = []
    staged = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, name: seen.append((name, out := staged(df, name))) or out)
    mixing.mix(docs)
    last = [df for name, df in seen if name == "mix-border"][-1]
    assert len([n for n, _ in seen if n == "mix-border"]) > 3 and last.agg(F.max("n")).first()[0] <= 5
    # Rows of one key cannot be cut, and end the search.
    same = spark.createDataFrame([(7, "a b c", "en", "x", 5)] * 30, docs.schema)
    assert {r.taken for r in mixing.mix(same).collect()} <= {0, 3, 6}
