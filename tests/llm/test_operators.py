"""The ten operators on small tables: brute force beside them, and the defined results of odd inputs."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekeeper.llm import (
    decontaminate, hashing, jaccard_join, lm_trie, mixing, pii, quality_rules, token_cache, tool_calls, toxicity, warc,
)
from tablekeeper.llm.components import components
from tablekeeper.llm.elias_fano import BigramTrie, EliasFano
from tablekeeper.session import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, host string, n string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(i * int(rng.integers(1, 9))) for i in rng.integers(0, len(WORDS), n))


def table(spark, texts, sources=None):
    """Rows with NULLs and extra columns of clashing names."""
    rows = [(i, t, None, (sources or ["a"] * len(texts))[i], None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n ", "one", "Same text here", "Same text here", "word " * 30_000, "é ß 漢字 " * 50]


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, ODD, ["a", None, "b", "a", None, "c", "c", "a"])
    twice = docs.where("doc_id = 4")
    none = docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(twice).unionByName(none)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_follow_words():
    texts = ["A b", None, "", "b\ta a" + "x" * (3 << 20), " a  B "]
    hashes, bounds, short = hashing.word_hashes(pa.array(texts), prefix=2)
    want = [w.lower() for t in texts for w in words_of(t)]
    assert list(np.diff(bounds)) == [len(words_of(t)) for t in texts]
    assert all((want[i] == want[j]) == (hashes[i] == hashes[j]) for i in range(len(want)) for j in range(len(want)))
    assert short[want.index("a")] == hashes[want.index("a")]


# --- 1 -------------------------------------------------------------------------------------------

def repeated(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    return len({p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)})


def test_quality_measures(spark, odd):
    got = quality_rules.judged(odd).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = ODD[3 if r.doc_id is None else r.doc_id] or ""
        lines = [line for line in text.split("\n") if words_of(line)]
        assert r.n_words == len(words_of(text)) and r.word_chars == sum(map(len, words_of(text)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeated(words_of(text))
        assert r.kept in (True, False)


def test_frequent_lines_reject_depleted_documents(spark):
    own = [prose(i, 40) for i in range(8)]
    boiler = prose(99, 60)
    texts = [f"{own[i]}\n{boiler}" if i < 6 else own[i] for i in range(8)] + [boiler.upper()]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in quality_rules.judged(docs, least=5, least_percent=30).collect()}
    assert [got[i].removed_words for i in range(9)] == [60] * 6 + [0, 0, 60]
    assert [got[i].kept for i in range(9)] == [True] * 8 + [False]
    assert not any(r.removed_words for r in quality_rules.judged(docs, least=7).collect())
    assert not any(r.removed_words for r in quality_rules.judged(docs, percent=78).collect())  # 7 of 9 have it
    assert sum(r.removed_words > 0 for r in quality_rules.judged(docs, percent=77).collect()) == 7
    left = {r.doc_id: r.text for r in quality_rules.cleaned(docs, least=5).collect()}
    assert left[0] == own[0] and left[7] == own[7] and left[8] == ""


def test_one_document_many_times_counts_once(spark):
    docs = table(spark, [prose(1, 30)])
    many = docs.crossJoin(spark.range(9).select(F.col("id").alias("copy"))).drop("copy")
    assert {r.kept for r in quality_rules.judged(many, least=5).collect()} == {True}


def test_the_limit_decides_on_the_tables(spark):
    """Documents of the test tables lose lines, and some are rejected for it alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judged(docs).collect()
    assert sum(r.removed_words > 0 for r in got) > 20
    depleted = {r.doc_id for r in got if not r.base_failed and not r.kept}
    assert depleted and all(r.kept for r in quality_rules.judged(docs, least=10**9).collect() if r.doc_id in depleted)


# --- 2 -------------------------------------------------------------------------------------------

def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 1 << 64), (3000, 4000), (500, 1 << 41)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        coded = EliasFano(values, top)
        x = np.concatenate((values, rng.integers(0, top, 200, dtype=np.uint64)))
        want = np.searchsorted(values, x)
        assert (coded.successor(x) == want).all()
        assert (coded.search(x)[1] == np.isin(x, values)).all()
        assert (coded.access(np.arange(n)) == values).all()


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_scores_are_those_of_the_model(spark, shard):
    texts = [prose(i % 20, 5 + i) for i in range(40)] + [None, "", "The END the"]
    docs = table(spark, texts)
    tokens = [[w.lower() for w in words_of(t)] + [0] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c, pairs = collections.Counter(), collections.Counter()
    for w, out in zip(tokens, held):
        if not out:
            c.update(w)
            pairs.update(zip([1] + w[:-1], w))
    n, v, trained = sum(c.values()), len(c), held.count(False)
    got = lm_trie.score(docs, shard).collect()
    assert len(got) == len(texts)
    for r in got:
        w = tokens[r.doc_id]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((pairs[p, x] + lm_trie.MASS * (c[x] + 1) / (n + v + 1))
                               / ((trained if p == 1 else c[p]) + lm_trie.MASS)) for p, x in zip([1] + w[:-1], w))
        assert r.held_out == held[r.doc_id] and r.train_tokens == n
        assert r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) <= lm_trie.STEP * 1.5 * len(w) + 1e-6


def test_stored_trie_answers_like_a_dictionary():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    keys = np.unique((rng.integers(0, len(words), 2000).astype(np.uint64) << np.uint64(40))
                     | rng.integers(0, 1 << 40, 2000, dtype=np.uint64))
    parents, contexts = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)
    codes = rng.integers(0, 1 << 16, len(keys)).astype(np.uint16)
    unseen = rng.integers(0, 1 << 16, len(words)).astype(np.uint16)
    built = BigramTrie(words, np.arange(len(words)), unseen, unseen, parents, contexts, codes, 40)
    trie = BigramTrie.mapped(built.stored())
    assert isinstance(trie.contexts.low, np.memmap)
    assert (trie.find_words(words) == np.arange(len(words))).all()
    assert (trie.find_words(words[words > 0] - np.uint64(1)) == -1).all()
    assert (trie.find(parents, contexts) == codes).all()
    other = rng.integers(0, len(words), 500)
    assert (trie.find(other, rng.integers(0, 1 << 40, 500, dtype=np.uint64)) == unseen[other]).all()
    empty = BigramTrie.mapped(BigramTrie(*[np.array([], t) for t in (
        "u8", "i8", "u2", "u2", "i8", "u8", "u2")], 40).stored())
    assert (empty.find_words(words) == -1).all()


def test_a_published_model_scores_other_documents(spark):
    docs = table(spark, [prose(i % 20, 30) for i in range(40)])
    path = work_dir(spark, "model")
    lm_trie.train(docs, 40, path)
    model = lm_trie.open_model(spark, path)
    own = {r.doc_id: r.score for r in lm_trie.score(docs, 40).collect()}
    assert {r.doc_id: r.score for r in lm_trie.score(docs, model=model).collect()} == own
    shuffled = [" ".join(reversed(prose(i, 30).split())) for i in range(20)] + ["unheard-of zzz"]
    others = lm_trie.score(table(spark, shuffled), model=model).orderBy("doc_id").collect()
    assert others[-1].n_known == 1 and others[0].train_tokens == model.total
    # the same words in an order that the trie has not seen are less likely
    assert sum(r.base_score for r in others[:20]) == pytest.approx(
        sum(r.base_score for r in lm_trie.score(docs.limit(20), model=model).collect()), rel=0.2)
    assert sum(r.score for r in others[:20]) < sum(own[i] for i in range(20)) - 10
    # without its tries the model knows no word
    bare = model._replace(tries=model.tries.limit(0))
    assert all(r.n_known == 0 for r in lm_trie.score(docs, model=bare).collect())


# --- 3 -------------------------------------------------------------------------------------------

def test_targets_and_takes(spark):
    sizes = [("a", 900), ("b", 50), ("c", 300), (None, 40)]
    texts = [prose(i, n) for i, (_, n) in enumerate(sizes) for _ in range(10)]
    docs = table(spark, texts, [s for s, _ in sizes for _ in range(10)])
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect())) if all(r.source for r in got) else True
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = 1.5 * sum(10 * n for _, n in sizes)
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    caps, target, rest = {s: 20.0 * n for s, n in sizes}, {}, dict(weights)
    left = total
    while True:
        over = [s for s in rest if left * weights[s] / sum(rest.values()) > caps[s]]
        if not over:
            break
        for s in over:
            target[s] = caps[s]
            rest.pop(s)
        left = total - sum(target.values())
    target |= {s: left * weights[s] / sum(rest.values()) for s in rest}
    for s, n in sizes:
        rows = by[s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == 10 * n for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= n and all(r.taken <= 2 * r.size for r in rows)


# --- 4 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_cached_counts(spark, odd, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    extra = ["  two  blanks ", " lead", "tail ", "a\n\nb", "▁ mark", "<s> </s> <unk>"]
    docs = odd.unionByName(table(spark, extra).withColumn("doc_id", F.col("doc_id") + 100))
    cache = work_dir(spark, "cache-test")
    texts = dict(enumerate(ODD)) | {100 + i: t for i, t in enumerate(extra)} | {None: ODD[3]}
    for _ in range(2):  # the second time everything is in the cache
        got = token_cache.token_counts(docs, path, cache).collect()
        assert len(got) == len(ODD) + 2 + len(extra)
        assert all(r.n_tokens == count(texts[r.doc_id] or "") for r in got)
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got)
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
        assert spark.read.parquet(cache).select("digest").distinct().count() == len(
            {t or "" for t in texts.values()})


def test_copies_are_encoded_once_and_cached_texts_not_again(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path, cache, sent = public.path("piece_bpe_32k.model"), work_dir(spark, "tokens"), []
    copies = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(prose(5, 40)).alias("text"))
    encode = token_cache.encoded

    def counted(texts, path):
        sent.append(texts.count())
        return encode(texts, path)

    monkeypatch.setattr(token_cache, "encoded", counted)
    more = copies.limit(3).unionByName(spark.createDataFrame([(7, "new text")], "doc_id long, text string"))
    assert len({r.n_tokens for r in token_cache.token_counts(copies, path, cache).collect()}) == 1
    assert token_cache.token_counts(copies, path, cache).count() == 500
    assert token_cache.token_counts(more, path, cache).count() == 4
    assert sent == [1, 0, 1] and spark.read.parquet(cache).count() == 2


# --- 5 -------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]


PRIVATE = [
    "mail a.b@c.example.com, or x@y then z@q.r_s@t.u end", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 010.0.0.1", "n@@m.co @a.b",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (456) 555-2186, +44 20 1 and +1 987 654 3210 4111111111111111",
    "é漢 a@b.cd 漢 1.1.1.1", "7" * 30_000, "a" * 30_000 + "@", "9.9.9.9@8.8.8.8", None, "",
] + [f"tel +1 (200) 555-{1000 + i} mail u{i}@m{i}.example.org" for i in range(40)]


def test_base_spans_and_redaction(spark):
    docs = table(spark, PRIVATE)
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.spans(docs, model).withColumn("base_text", pii.written("base")).collect()}
    for i, text in enumerate(PRIVATE):
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN)
                      for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m.group()))
        assert got[i].base_text == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert {(x.s, x.k, x.e) for x in got[i].spans} >= set(want)
    clean = {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}
    assert clean[5] == "é漢 [EMAIL] 漢 [IP]" and clean[9] is None and clean[10] == ""
    assert pii.redacted(docs, {}).columns == docs.columns


def test_planted_cases_beyond_the_base_patterns_are_found(spark):
    cards = ["4111111111111111", "5500005555555559", "4012 8888 8888 1881", "340000000000009"]
    texts = [f"{prose(i, 8)}, tel +1 (200) 555-{1000 + i} mail u{i}@m{i}.example.org card {cards[i % 4]} or a@b, "
             f"on 2024-01-{10 + i % 20} 12 30 to 12 34 56 78 90 12, lot {10**15 + i} at 10.0.{i}.7, 1,2,3,4" for i in range(60)]
    # Half of the real cases are beyond the base patterns.
    planted = [("phone", "(555) 123-4567"), ("phone", "555-123-4568"), ("email", "jane.doe (at) host.example.org"),
               ("email", "jan[at]host.org"), ("card", "4111.1111.1111.1111"), ("card", "5500/0055/5555/5559"),
               ("phone", "030 1234 5678"), ("ip", "10 . 0 . 0 . 1")]
    cue = {"phone": "tel", "email": "mail", "card": "card", "ip": "host"}
    texts += [f"{prose(100 + i, 8)}, {cue[k]} {what} end" for i, (k, what) in enumerate(planted * 8)]
    wrong = ["2024-01-05 12 30", "2019 2020 2021 2022", "12 34 56 78 90 12", "4111.1111.1111.1112", "a@b", "1,2,3,4"]
    texts += [f"{prose(200 + i, 8)}, so {what} end" for i, what in enumerate(wrong * 3)]
    docs = table(spark, texts)
    model = pii.train(docs)
    rows = pii.spans(docs, model).collect()
    got = {r.doc_id: [(pii.KINDS[x.k], r.text[x.s:x.e]) for x in r.spans] for r in rows}
    assert [got[60 + i] for i in range(64)] == [[x] for x in planted * 8]
    assert not any(got[i] for i in range(124, len(texts)))
    assert all(r.spans == r.base and len(r.base) >= 3 for r in rows if r.doc_id < 60)
    clean = {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}
    assert clean[60].endswith("tel [PHONE] end") and clean[62].endswith("mail [EMAIL] end") and clean[64].endswith("card [CARD] end")


def test_thresholds_decide_on_hard_negatives(spark):
    """Precision and recall of added spans, where half of the look-alikes keep the format; without the thresholds
    they would be added."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424"]
    cut = lambda sign: [sign.join(c[i:i + 4] for i in range(0, 16, 4)) for c in cards]
    plain, slashed = cut(" "), cut("/")  # the base pattern takes the first form only
    seen = [f"{prose(i, 8)}, {('card', 'so')[i % 2]} {plain[i % 4]} so {prose(300 + i, 4)}, "
            f"{('invoice', 'lot', 'serial no')[i % 3]} {slashed[(i + 1) % 4]} end" for i in range(80)]
    real = [f"{prose(400 + i, 8)}, {('card', 'visa', 'then')[i % 3]} {slashed[i % 4]} end" for i in range(40)]
    other = [f"{prose(500 + i, 8)}, {('order', 'batch', 'ref', 'item no')[i % 4]} {slashed[i % 4]} end" for i in range(40)]
    broken = [f"{prose(600 + i, 8)}, so {slashed[i % 4][:-1]}{9 - int(slashed[i % 4][-1])}1 end" for i in range(40)]
    docs = table(spark, [*seen, *real, *other, *broken])
    model = pii.train(docs)

    def added(model):
        rows = pii.spans(docs, model).where(F.size("spans") > F.size("base")).select("doc_id").collect()
        return {r.doc_id for r in rows}

    got, truth = added(model), set(range(80, 120))
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.95 * len(got)
    open_ = added({kind: (trees, -math.inf) for kind, (trees, _) in model.items()})
    assert len(open_ - truth) >= 80 and open_ > got


def test_thresholds_decide_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    count = lambda m: pii.spans(docs, m).agg(F.sum(F.size("spans") - F.size("base"))).first()[0]
    assert 0 < count(model) < count({kind: (trees, -math.inf) for kind, (trees, _) in model.items()})


def test_trees_learn_a_feature():
    base = dict.fromkeys(pii.VALUES, 0)
    rows = [({**base, "luhn": a, "digits": b}, 90 if a else 1, 1 if a else 90) for a in (0, 1) for b in range(4)]
    trees = pii.boost(rows)
    score = lambda f: pii.tree_score(trees, lambda name: f[name])
    assert all((score(f) > 0) == bool(f["luhn"]) for f, _, _ in rows)


# --- 6 -------------------------------------------------------------------------------------------

def test_toxic_documents_are_found(spark, odd):
    rng = np.random.default_rng(5)
    bad = ["vileword", "nastyterm", "uglyslur"]
    texts, toxic = [], []
    for i in range(240):
        words = prose(i, 60).split()
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for at in rng.integers(0, 60, 1 + i % 7):
                words[at] = bad[int(rng.integers(0, 3))]
        texts.append(" ".join(words))
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i < 160] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model, carry=["source"]).collect()}
    right = sum(got[i].rejected == toxic[i] for i in range(160, 240))
    assert right >= 78 and (np.diff(model.thresholds) > 0).all()
    assert all(abs(sum(r[f"p_{k}"] for k in range(4)) - 1) < 1e-9 for r in got.values())
    many = [got[i].severity for i in range(240) if toxic[i] and i % 7 >= 5]
    few = [got[i].severity for i in range(240) if toxic[i] and i % 7 == 0]
    assert np.mean(many) > np.mean(few)
    assert not any(r.rejected for r in toxicity.scored(odd, model).collect())
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert not any(r.rejected for r in toxicity.scored(docs, none).collect())


def test_few_toxic_labels_give_features(spark):
    bad = ["vileword", "nastyterm", "uglyslur"]
    texts = [f"{prose(i, 40)} {bad[i % 3]} {bad[i % 3]}" if i < 18 else prose(i, 40) for i in range(200)]
    docs = table(spark, texts)
    # Six of the eighteen toxic documents have labels, each word lies in two of them.
    labels = spark.createDataFrame([(i, 1, int(i < 6)) for i in range(200) if i < 6 or 18 <= i < 120],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    held_out = {r.doc_id: r.rejected for r in toxicity.scored(docs, model).collect() if r.doc_id in range(6, 18)
                or r.doc_id >= 120}
    assert sum(held_out[i] for i in range(6, 18)) >= 11 and sum(held_out[i] for i in range(120, 200)) <= 2
    assert [toxicity.least_seen(n) for n in (1, 3, 4, 11, 15, 16, 63, 64, 449, 10**6)] == [1, 1, 2, 2, 2, 3, 3, 4, 4, 4]


# --- 7 -------------------------------------------------------------------------------------------

def test_tool_calls(spark):
    schema = "conv_id long, msg_id string, seq long, kind string, role string, call_id string, tool string, " \
             "arguments string, content string, after string"
    rows = [
        (1, "r", 0, "result", "tool", "x", None, None, "late", None),
        (1, "c", 5, "call", "user", "x", "reply", '{"turn":1,"text":"hé\\n"}', None, "m"),
        (1, "m", 1, "message", "system", None, None, None, None, None),
        (1, "c2", 6, "call", "user", "x", "reply", "{", None, "r"),
        (1, "o", 7, "result", "tool", "none", None, None, "lost", None),
        (2, "a", 0, "message", "user", None, None, None, "a", "b"), (2, "b", 1, "message", "user", None, None, None, "b", "a"),
        (None, "u", 0, "call", "user", "x", "other", '{"a":1}', None, "gone"),
    ]
    messages = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.msg_id): r for r in tool_calls.formatted(messages).collect()}
    assert {k: (r.status, r.depth) for k, r in got.items()} == {
        (1, "m"): ("plain", 0), (1, "c"): ("linked", 1), (1, "r"): ("linked", 2), (1, "c2"): ("repeated", 3),
        (1, "o"): ("orphan", 0), (2, "a"): ("cycle", None), (2, "b"): ("cycle", None), (None, "u"): ("unanswered", 0)}
    assert got[1, "c"].valid and got[1, "c"].json == (
        '{"content":null,"role":"user","tool_call":{"arguments":{"text":"hé\\n","turn":1},"id":"x","name":"reply"}}')
    assert got[1, "c2"].errors == "$: no JSON" and got[None, "u"].errors == "$: no schema"
    assert tool_calls.formatted(messages.limit(0)).count() == 0
    assert tool_calls.violations({"turn": -1, "q": 1}, tool_calls.SCHEMAS["reply"]) == [
        "$.text: missing", "$.q: unknown", "$.turn: too small"]


def plain_depths(messages):
    """Depth by walking up, of (conv, id, seq, parent) rows with an id."""
    first = {}
    for conv, i, seq, parent in messages:
        key = ((seq is not None, seq or 0), (parent is not None, parent or ""))
        if (conv, i) not in first or key < first[conv, i][0]:
            first[conv, i] = (key, parent)

    def depth(conv, parent, seen=()):
        if (conv, parent) not in first:
            return 0
        if parent in seen:
            return None
        up = depth(conv, first[conv, parent][1], (*seen, parent))
        return None if up is None else up + 1

    return collections.Counter((conv, i, seq, depth(conv, parent)) for conv, i, seq, parent in messages)


def test_depths_of_random_messages(spark):
    """Forests with repeated ids, cycles, lost parents and NULLs against walking up."""
    rng = np.random.default_rng(11)
    rows = []
    for conv in [None, *range(12)]:
        ids = [f"m{k}" for k in range(int(rng.integers(1, 14)))]
        for _ in range(int(rng.integers(1, 30))):
            seq = None if rng.random() < 0.1 else int(rng.integers(0, 9))
            after = None if rng.random() < 0.2 else str(rng.choice([*ids, "gone"]))
            rows.append((conv, str(rng.choice(ids)), seq, "message", "user", None, None, None, "é" * 50_000 if not len(rows)
                         else None, after))
    messages = spark.createDataFrame(rows, "conv_id long, msg_id string, seq long, kind string, role string, call_id string, "
                                     "tool string, arguments string, content string, after string")
    got = tool_calls.formatted(messages).select("conv_id", "msg_id", "seq", "depth").collect()
    want = plain_depths([(r[0], r[1], r[2], r[9]) for r in rows])
    assert collections.Counter(map(tuple, got)) == want


def test_long_chain_of_calls(spark):
    chain = spark.range(300).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        .alias("role"), F.lit("t").alias("text"))
    got = tool_calls.formatted(tool_calls.as_messages(chain))
    assert got.where("depth = seq AND status = 'linked'").count() == 300


def test_turns_without_number_are_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "user", "c"), (1, None, "user", "c"),
            (1, None, "assistant", "d"), (2, None, None, None), (None, None, "user", "e"), (None, 0, "user", "f")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.formatted(tool_calls.as_messages(turns)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.conv_id, r.msg_id, r.seq, r.depth, r.status, r.valid) for r in got), key=key) == sorted([
        (1, "0", 0, 0, "linked", True), (1, "1", 1, 1, "linked", None), (1, None, None, 0, "unanswered", False),
        (1, None, None, 0, "unanswered", False), (1, None, None, 0, "orphan", None), (2, None, None, 0, "plain", None),
        (None, None, None, 0, "unanswered", False), (None, "0", 0, 0, "unanswered", True)], key=key)
    lost = [r for r in got if r.msg_id is None]
    assert {r.errors for r in lost} == {"", "$.turn: missing"} and {r.json for r in lost if r.conv_id == 1} == {
        '{"content":null,"role":"user","tool_call":{"arguments":{"text":"c"},"id":null,"name":"reply"}}',
        '{"content":"d","role":"assistant","tool_call_id":null}'}
    # A call or result without id takes nothing from those that have one.
    named = [(1, "c", 1, "call", "user", "x", "reply", "{}", None, None), (1, "r", 2, "result", "tool", "x", None, None, "", None),
             (1, None, 0, "call", "user", "x", "reply", "{}", None, "c"), (1, None, 0, "result", "tool", "x", None, None, "", None)]
    got = tool_calls.formatted(spark.createDataFrame(
        named, "conv_id long, msg_id string, seq long, kind string, role string, call_id string, tool string, "
               "arguments string, content string, after string")).collect()
    assert sorted((r.msg_id or "", r.status, r.depth) for r in got) == [
        ("", "orphan", 0), ("", "unanswered", 0), ("c", "linked", 0), ("r", "linked", 1)]


# --- 8 -------------------------------------------------------------------------------------------

def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("limit", [64 << 20, 60])
def test_benchmark_windows(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)  # the small one makes several automata
    items = [prose(1, 14), "Short Item é!", None, "...", prose(1, 14), "漢字"]
    texts = [f"{prose(7, 5)}, {prose(1, 14).upper()}. {prose(8, 5)}", "a short\nITEM É é, short item é", prose(1, 9), None, "",
             "x漢字 漢字", prose(1, 14)[1:], "clean " * 50]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, "q w", "x")],
                                  "item_id long, text string, n_words string")
    found = decontaminate.contaminated(table(spark, texts), bench, carry=["text", "source"]).collect()
    assert len(found) == len(texts)
    for r in found:
        words, hit, ids = normal(texts[r.doc_id]), set(), set()
        for i, t in [*enumerate(items), ("", "q w")]:
            w = normal(t)
            k = min(10, len(w))
            for a in range(len(w) - k + 1 if w else 0):
                for at in range(len(words) - k + 1):
                    if words[at:at + k] == w[a:a + k]:
                        hit.update(range(at, at + k))
                        ids.add(str(i))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        cut = [texts[r.doc_id][a:b] for a, b in decontaminate.hit_spans(r.text or "", r.hits)]
        assert sum(len(normal(c)) for c in cut) == len(hit)
    assert decontaminate.contaminated(table(spark, texts), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("lane", [1, 7, 256])
def test_automaton_beside_brute_force(monkeypatch, lane):
    """Few words, so that windows overlap, contain one another and end within each other's beginnings."""
    monkeypatch.setattr(decontaminate, "LANE", lane)
    monkeypatch.setattr(decontaminate, "BUILD_ROWS", 11)
    rng = random.Random(lane)
    windows = {tuple(rng.choices("abc", k=10)) for _ in range(60)} | {
        tuple(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(12)} - {(w,) for w in "abc"}
    items = {w: sorted({str(rng.randint(0, 9)) for _ in range(rng.randint(1, 3))}) for w in windows}
    texts = [" ".join(rng.choices("abcde", (5, 5, 5, 1, 1), k=rng.choice([0, 1, 9, 40, 300]))) for _ in range(40)]
    texts += [" ".join(w) for w in sorted(windows)] + [None, ""]
    machine = decontaminate.opened(decontaminate.packed(decontaminate.build(
        pa.chunked_array([pa.array([" ".join(w) for w in windows])]), pa.chunked_array([pa.array([items[w] for w in windows])]))))
    for text, (n, runs, found) in zip(texts, decontaminate.scan(texts, machine), strict=True):
        words, hit, ids = (text or "").split(), set(), set()
        for w in windows:
            for at in range(len(words) - len(w) + 1):
                if tuple(words[at:at + len(w)]) == w:
                    hit.update(range(at, at + len(w)))
                    ids.update(items[w])
        assert n == len(words) and found == sorted(ids)
        assert [i for a, b in runs for i in range(a, b)] == sorted(hit)


# --- 9 -------------------------------------------------------------------------------------------

def shingles(text):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return sets, [root(i) for i in range(len(texts))]


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_SETS", 3)
    rng = np.random.default_rng(3)
    texts = [None, "", "one two", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    passage = prose(1000, 60)
    for family in range(6):  # edits of edits: chains, near misses and copies
        words = prose(family, 120).split()
        texts += [" ".join(words)] * 2
        for step in range(12):
            words = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
                words[at] = f"edit{family}x{step}x{at}"
            texts.append(" ".join(words))
    texts += [f"{prose(2000 + i, int(rng.integers(5, 60)))} {passage}" for i in range(40)]
    sets, roots = brute_components(texts)
    got = jaccard_join.joined(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [
        (i, len(sets[i]), roots[i]) for i in range(len(texts))]
    assert jaccard_join.joined(table(spark, texts).limit(0)).count() == 0


def test_join_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id) for r in jaccard_join.joined(odd).collect()}
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (None, 3), (4, 4), (5, 4), (6, 6)} <= got


def test_prefix_tree_finds_what_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(20, 90, 120)]
    tree = jaccard_join.PrefixTree(sets)
    for probe in sets[:40]:
        want = {i for i, s in enumerate(sets) if 9 * len(np.intersect1d(s, probe)) >= 4 * (len(s) + len(probe))}
        assert set(tree.linked(probe)) == want and len(tree.linked(probe, first=True)) == min(1, len(want))


def test_components_of_paths_and_rings(spark):
    links = [(i, i + 1) for i in range(-20, 20)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).select("id", "component").collect())
    assert got == {i: -20 for i in range(-20, 21)} | {100: 100, 101: 100, 102: 100}


# --- 10 ------------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200, "y" * 1000
    pages = [(1, "http://a b/\n", big), (2, None, big), (7, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "", None),
             (-6, "u", other), (6, "u", other), (None, "u", other)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    out = work_dir(spark, "warc-test")
    warc.write_warcs(warc.pages_to_arcs(frame), out)
    got = {r.page_id: r for r in warc.read_warcs(spark, out).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        data = (html or "").encode()
        assert got[page].payload_bytes == len(data) and got[page].payload_digest == hashlib.sha1(data).hexdigest()
    assert {k: r.refers_to for k, r in got.items()} == {
        1: 7, 2: 7, 7: None, 3: None, 4: None, 5: None, -6: 6, 6: None, None: None}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got.values())
    empty = work_dir(spark, "warc-empty")
    warc.write_warcs(warc.pages_to_arcs(frame.limit(0)), empty)
    assert warc.read_warcs(spark, empty).count() == 0


@pytest.mark.parametrize("page", [None, 5])
def test_equal_pages_spread_over_files(spark, page):
    """200 equal rows beside 100 others; no file holds more than four times the mean of 30 files."""
    page_id = F.when(F.col("id") < 200, F.lit(page).cast("long")).otherwise(F.col("id"))
    frame = spark.range(300).select(page_id.alias("page_id"), F.lit("u").alias("url"), F.lit("z" * 1000).alias("html"))
    out = work_dir(spark, "warc-spread")
    warc.write_warcs(warc.pages_to_arcs(frame), out, archive_bytes=10_000)
    files = [list(warc.parse_warc(gzip.decompress(r.content))) for r in spark.read.format("binaryFile").load(out).collect()]
    assert sum(map(len, files)) == 300 and max(map(len, files)) <= 40
    got = warc.read_warcs(spark, out).groupBy(F.col("page_id").eqNullSafe(F.lit(page)).alias("equal"), "refers_to").count()
    assert {(r.equal, r.refers_to): r["count"] for r in got.collect()} == {
        (True, None if page is None else 299): 200, (False, 299): 99, (False, None): 1}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    rows = [("http://a", "1.2.3.4", "20240102030405", "text/html", 200, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nx"),
            ("http://b", "1.2.3.4", "1999", "text/plain", 404, b"")]
    content = warc.arc_archive("a.arc", version, rows)
    got = list(warc.parse_arc(content))
    assert [(r["url"], r["date"], r["body"]) for r in got] == [(r[0], r[2], r[5]) for r in rows]
    assert [r["status"] for r in got] == ([None, None] if version == 1 else ["200", "404"])
    assert warc.warc_date("20240102030405") == "2024-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(content[:-5]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(content.replace(b" 404 ", b" ", 1) if version == 2 else content.replace(b"1 0 t", b"3 0 t", 1)))


def test_empty_table(spark):
    none = table(spark, ["a"]).limit(0)
    assert quality_rules.judged(none).count() == 0 and mixing.mix(none).count() == 0
    assert lm_trie.score(none).count() == 0 and pii.spans(none, pii.train(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    public = pytest.importorskip("public_tokenizers")
    cache = work_dir(spark, "no-tokens")
    assert token_cache.token_counts(none, public.path("piece_bpe_32k.model"), cache).count() == 0
