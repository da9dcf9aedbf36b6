"""Vector codes, the URL filter and the filter audit beside brute force, and their defined results."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeeper.llm import filter_audit, url_filter, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, near string, ints int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], VECTORS)


# --- 11 ------------------------------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract by loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        out = []
        for pieces in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(pieces[p], entry)), e) for e, entry in enumerate(books[p]))
                    for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = collections.defaultdict(list)
            for pieces, best in zip(cut, found):
                members[best[p][1]].append(pieces[p])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in best) for best in found]
    by_label = collections.Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return collections.Counter(
        (i, "".join(f"{e:02x}" for _, e in best), error, by_label[label], digest)
        for (i, _, label), best, error in zip(kept, found, errors))


def spark_codes(spark, monkeypatch, rows):
    frame = vectors(spark, rows)
    monkeypatch.setattr(vector_codes, "load", lambda *a: frame)
    return collections.Counter(map(tuple, vector_codes.op11_vector_codes(spark, "").select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_codes_follow_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, rows[3][1], None) for i in range(40)] + [rows[7], rows[7]]
    rows += [(301, None, 1), (302, [None] + rows[0][1][1:], 1), (303, [math.nan] * 32, 1), (304, [math.inf] * 32, 2),
             (None, rows[9][1], 2), (None, rows[8][1], None)]
    assert spark_codes(spark, monkeypatch, rows) == plain_codes(rows)


def test_ties_and_few_vectors(spark, monkeypatch):
    rows = [(i, [float((i + k) % 2) for k in range(16)], 0) for i in range(5)] + [(9, [0.5] * 16, 1)]
    assert spark_codes(spark, monkeypatch, rows) == plain_codes(rows)


def test_vectors_of_other_lengths_and_none(spark):
    good = [1.0] * 16
    codes, books = vector_codes.fit_codes(vectors(spark, [
        (1, [], 0), (2, [1.0] * 7, 0), (3, good, 0), (4, [2.0] * 32, 0), (5, [1e30] * 16, 0)]))
    assert {r.id for r in codes.collect()} == {3, 5} and books.max() <= vector_codes.LARGEST
    for rows in ([], [(1, None, 0)], [(1, [1.0] * 5, 0)]):
        codes, books = vector_codes.fit_codes(vectors(spark, rows))
        assert codes.collect() == [] and books is None


def test_pivots_spare_distances_and_lose_none():
    rng = np.random.default_rng(1)
    block, entries = rng.integers(-200, 200, (500, 4)), rng.integers(-200, 200, (64, 4))
    entries[9] = entries[4]
    pivots = entries[vector_codes.choose_pivots(entries)]
    near, entry_near = np.sqrt(vector_codes.squares(block, pivots)), np.sqrt(vector_codes.squares(entries, pivots))
    index, distance, tried = vector_codes.nearest(block, near, entries, entry_near)
    whole = vector_codes.squares(block, entries)
    assert (index == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert tried < 0.35 * whole.size
    # Without pivots nothing is spared: the bounds decide what is computed.
    assert vector_codes.nearest(block, near[:, :0], entries, entry_near[:, :0])[2] == whole.size


# --- 12 ------------------------------------------------------------------------------------------

URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x?q=/es/", "http://a.www.example.com/en/", "x.com/en/",
    "http://b.example.com/en", "http://example.com", "http://site.net/es/1#t", "http://site.net/de/1",
    "http://spam-farm.net/fr/", "http://m.spam-farm.net/", "http://cheap-pills.org?x", "http://pills.org.de/#/en/",
    None, "", "://", "a://", "ftp://com/", "http://notexample.com/en/", "http://com.example/en/", "http://a..com/x",
    "http://É.example.com/en/é", "http://x.net/es", "http://" + "a." * 3000 + "com/" + "p/" * 5000, "http://h\n.net/es/\n",
]
#: Hosts of which a block list names some.
MANY = [f"h{i}.org" for i in range(3000)]


def plain_verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    under = lambda own: host == own or host.endswith("." + own)
    fit = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules
           if under(r.split("/")[0]) and path.startswith(r[len(r.split("/")[0]):])]
    if fit:
        _, _, rule, verdict = max(fit)
        return host, path, rule, verdict
    return host, path, None, "block" if any(map(under, listed)) else "allow"


def pages_of(spark, urls):
    return spark.createDataFrame(
        [(i, u, "html", "h", "p", "r", "v", "k", True) for i, u in enumerate(urls)],
        "page_id long, url string, html string, host string, path string, rule string, verdict string, key string, "
        "blocked boolean")


def judged(spark, urls, rules, listed, **more):
    out = url_filter.judge(
        pages_of(spark, urls), url_filter.values(spark, ["rule", "verdict"], rules),
        spark.createDataFrame([(h,) for h in listed], "host string"), **more)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return [tuple(r)[1:] for r in out.orderBy("page_id").collect()]


def test_urls_follow_loops(spark):
    listed = ["spam-farm.net", "cheap-pills.org", None]
    assert judged(spark, URLS, url_filter.RULES, listed) == [
        plain_verdict(u, url_filter.RULES, ["spam-farm.net", "cheap-pills.org"]) for u in URLS]


def test_lists_of_several_parts(spark):
    urls = [f"http://{h}/{'abc'[i % 3]}/x" for i, h in enumerate(MANY)] + ["http://www.h4.org/a/", None]
    rules = [(f"h{i}.org/{'ab'[i % 2]}/", "block" if i % 3 else "allow") for i in range(0, 300, 2)] + [("org/b/", "allow")]
    listed = MANY[1::7]
    assert judged(spark, urls, rules, listed, part_bytes=256) == [plain_verdict(u, rules, listed) for u in urls]


@pytest.mark.parametrize("rules, listed", [([], []), ([], ["site.net"]), ([("net/", "block")], [])])
def test_empty_lists_and_tables(spark, rules, listed):
    assert judged(spark, URLS, rules, listed) == [plain_verdict(u, rules, listed) for u in URLS]
    assert judged(spark, [], rules, listed) == []


def test_a_cascade_is_exact_where_its_first_level_is_not(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_BITS", 2)
    monkeypatch.setattr(url_filter, "FIRST_HASHES", 1)
    monkeypatch.setattr(url_filter, "FURTHER_BITS", 1)
    universe = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(hash(key), 3) = 0")
    cascade = url_filter.build_cascade(listed, universe, "test", part_bytes=1 << 18)
    (levels,) = cascade.parts
    assert len(levels) > 4
    key = F.col("key")
    wrong = lambda c: universe.where(c != (F.pmod(F.hash("key"), F.lit(3)) == 0)).count()
    assert wrong(cascade.contains(key, 0)) == 0
    # Each level takes away wrong answers of those before it.
    shares = [wrong(url_filter._contains(levels[:n], key)) for n in range(1, len(levels) + 1)]
    assert shares[0] > 0 and shares[-1] == 0 and shares == sorted(shares, reverse=True)


def test_the_list_decides_the_query(spark, monkeypatch):
    pages = pages_of(spark, URLS)
    monkeypatch.setattr(url_filter, "load", lambda *a: pages)
    got = [tuple(r)[1:] for r in url_filter.op12_url_filter(spark, "").orderBy("page_id").collect()]
    listed = ["spam-farm.net", "m.spam-farm.net", "cheap-pills.org", "pills.org.de"]
    assert got == [plain_verdict(u, url_filter.RULES, listed) for u in URLS]
    assert {g[3] for g in got if g[2] is None} == {"allow", "block"}


# --- 13 ------------------------------------------------------------------------------------------

def fails(docs):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append("".join(name for name, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search("[#$%&*|]", text)),
            ("E", i is not None and i > first[text]),
        ) if bad))
    return out


def plain_audit(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    flags, rows, total = fails(docs), {}, collections.Counter()
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, flags) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                out = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[part, name] += len(out)
                rows[part, "".join(order), step] = (
                    len(left), len(out), sum(name in f for _, f in own) - len(out), sum(f == name for _, f in own),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
    return {(*key, *row, total[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


DOCS = "doc_id long, text string, source string, n long, part string, pattern string, good string, digest string"


def documents(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", "y", "z", "w") for d in docs], DOCS)


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*row, "x") for row in labels], "doc_id long, quality int, toxic int, part string")
    rows = filter_audit.audit(documents(spark, docs), frame).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_audit_follows_loops(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one", "A# " * 300, " ".join(f"w{i}" for i in range(250)),
             " ".join(f"W{i}" for i in range(250)), " ".join(f"é{i}%" for i in range(220)), "x " * 400, "w " * 50_000]
    docs = [(i, texts[int(rng.integers(0, len(texts)))], [None, "", "a", "b"][int(rng.integers(0, 4))])
            for i in range(120)]
    docs += [docs[3], docs[3], (500, texts[4], "c"), (None, texts[4], "c"), (None, None, "d")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 120, 2)]
    labels += [(None, 1, 1), (4, 1, 1), (7, None, 1), (9, None, None), (9999, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == set()
    docs = [(1, "a", "s"), (2, "a", "s")]
    assert audited(spark, docs, []) == plain_audit(docs, [])


def test_contractions_have_the_axes_of_the_filters():
    tensors = np.random.default_rng(2).integers(0, 9, (3, 2, 2, 2, 2, 2))
    of = filter_audit.contractions(tensors)
    kept, removed, failed, unique = of({1, 3}, 0)
    assert (kept == tensors[:, 0, 0, :, 0].reshape(3, -1).sum(1)).all()
    assert (removed == tensors[:, 1, 0, :, 0].reshape(3, -1).sum(1)).all()
    assert (failed == tensors[:, 1].reshape(3, -1).sum(1)).all() and (unique == tensors[:, 1, 0, 0, 0, 0]).all()
