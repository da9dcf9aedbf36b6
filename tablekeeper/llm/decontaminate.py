"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Each benchmark item is cut into windows of ten consecutive words (a shorter item is one window). All
windows go into one automaton over word numbers, which a task builds once and publishes as a table; every document
is scanned once, and hits are mapped back to words and to offsets of the original text.

Defined results: NULL text has no words and no hits; NULL item texts and items without words are left out;
NULL item ids are written as empty text; repeated items count each with their own id; an item id that
occurs twice is listed once; an empty benchmark hits nothing, an empty table gives no rows; other columns of either
table are ignored. Texts of any length are scanned whole, in lanes that overlap.
"""

import numpy as np
from pyspark.sql import functions as F

from tablekeeper.llm.tables import load, staged

WINDOW = 10
#: Largest total of window texts, in bytes, that one automaton may hold; more go into further ones.
AUTOMATON_BYTES = 64 << 20
#: Words of a lane, lanes being scanned side by side; characters of a block of texts; windows numbered at a time.
LANE, BLOCK_CHARS, BUILD_ROWS = 256, 4 << 20, 50_000
#: Bytes of an automaton in one row of the published table.
PIECE_BYTES = 8 << 20

# Bytes of words keep their value (letters in lower case), all others become a blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text):
    """Normalised words of a text, as byte strings."""
    return text.encode().translate(_NORMAL).split() if text else []


def windows(benchmark):
    """(window, items) for every distinct window of the benchmark, items being a sorted list of ids."""
    listed = F.regexp_extract_all(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), 0
    )
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), listed.alias("w")
    ).where(F.size("w") > 0)
    each = words.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))),
        lambda i: F.array_join(F.slice("w", i + 1, WINDOW), " "),
    )).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Automaton:
    """Aho-Corasick automaton over word numbers, in flat arrays of about 20 bytes a node.

    Node ``i + 1`` has ``keys[i]``, its parent's number times the number of words plus the word that leads to it. Nodes
    are numbered level by level in order of these keys, so that a transition is one binary search, and no list of children
    is kept. ``fail`` is the node of the longest proper suffix, ``out`` the longest suffix that is a window
    (the node itself included, 0: none), ``window`` the number of a node's window or -1.
    """

    def __init__(self, arrays):
        self.words, self.names = arrays["words"], arrays["names"]
        self.keys, self.levels = arrays["keys"], arrays["levels"]
        self.fail, self.out, self.window = arrays["fail"], arrays["out"], arrays["window"]
        self.bounds, self.items = arrays["bounds"], arrays["items"]
        self.number = {word: i for i, word in enumerate(self.words)}
        self.size = len(self.words)
        first = int(self.levels[1]) if len(self.levels) > 1 else 0
        self.first = np.zeros(self.size + 1, np.int64)  # no word, -1, leads from the last place back to the root
        self.first[self.keys[:first]] = np.arange(1, first + 1)

    def step(self, nodes, words):
        """Nodes after one more word each; -1 is a word of no window."""
        after = self.first[words]
        at = np.flatnonzero((nodes > 0) & (words >= 0))
        now, word = nodes[at], words[at].astype(np.int64)
        while len(at):
            wanted = now * self.size + word
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[place] == wanted
            after[at[found]] = place[found] + 1
            now = self.fail[now].astype(np.int64)
            left = ~found & (now > 0)  # at the root the word alone decides
            at, now, word = at[left], now[left], word[left]
        return after

    def found(self, flat):
        """(ends, nodes) of all windows in an array of word numbers.

        A node tells no more than the last ``WINDOW`` words, so the array is cut into lanes, each begun
        ``WINDOW - 1`` words before its own first, and all lanes go forward together.
        """
        lanes = -(-len(flat) // LANE)
        before = WINDOW - 1
        padded = np.full(before + lanes * LANE, -1, np.int32)
        padded[before : before + len(flat)] = flat
        rows = np.lib.stride_tricks.sliding_window_view(padded, LANE + before)[::LANE]
        nodes, ends, hits = np.zeros(lanes, np.int64), [], []
        for j in range(LANE + before):
            nodes = self.step(nodes, rows[:, j])
            if j >= before:
                out = self.out[nodes]
                here = np.flatnonzero(out)
                while len(here):
                    ends.append(here * LANE + (j - before))
                    hits.append(out[here])
                    out[here] = self.out[self.fail[out[here]]]
                    here = here[out[here] > 0]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ends), np.concatenate(hits).astype(np.int64)


def _numbered(found):
    """Words, and the windows as a matrix of word numbers, -1 after a short one's end, by way of blocks."""
    number, matrix = {}, np.full((len(found), WINDOW), -1, np.int32)
    for start in range(0, len(found), BUILD_ROWS):
        lists = [w.encode().split(b" ") for w in found.slice(start, BUILD_ROWS).to_pylist()]
        for i, words in enumerate(lists, start):
            matrix[i, : len(words)] = [number.setdefault(w, len(number)) for w in words]
    return list(number), matrix


def build(found, items):
    """Arrays of the automaton for Arrow columns of distinct windows and of their lists of items."""
    import pyarrow as pa

    words, matrix = _numbered(found)
    order = np.lexsort(matrix.T[::-1])
    matrix = matrix[order]
    size, keys, levels, parent = len(words), [], [0], np.zeros(len(matrix), np.int64)
    window, fresh = [np.full(1, -1, np.int32)], np.zeros(len(matrix), bool)
    fresh[0] = True
    for level in range(WINDOW):
        column = matrix[:, level]
        fresh[1:] |= column[1:] != column[:-1]
        there = column >= 0
        new = fresh & there
        keys.append(parent[new] * size + column[new])
        node = levels[-1] + np.cumsum(new)
        ended = there if level == WINDOW - 1 else there & (matrix[:, level + 1] < 0)
        last = np.full(int(new.sum()), -1, np.int32)
        last[node[ended] - 1 - levels[-1]] = np.flatnonzero(ended)
        window.append(last)
        parent = np.where(there, node, 0)
        levels.append(levels[-1] + int(new.sum()))
    listed = pa.concat_arrays(items.take(pa.array(order)).chunks)
    flat = listed.flatten().dictionary_encode()
    arrays = {
        "words": words, "names": flat.dictionary.to_pylist(),
        "keys": np.concatenate(keys), "levels": np.array(levels, np.int64), "window": np.concatenate(window),
        "fail": np.zeros(levels[-1] + 1, np.int32), "out": np.zeros(levels[-1] + 1, np.int32),
        "bounds": np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy()))).astype(np.int64),
        "items": flat.indices.to_numpy().astype(np.int32),
    }
    machine = Automaton(arrays)
    for low, high in zip(levels, levels[1:]):
        above, word = np.divmod(machine.keys[low:high], size)
        if low:  # the first level falls back to the root
            machine.fail[low + 1 : high + 1] = machine.step(machine.fail[above].astype(np.int64), word.astype(np.int32))
        nodes = np.arange(low + 1, high + 1)
        machine.out[nodes] = np.where(machine.window[nodes] >= 0, nodes, machine.out[machine.fail[nodes]])
    return arrays


def packed(arrays):
    """The arrays as one Arrow stream."""
    import pyarrow as pa

    kinds = {"words": pa.large_binary(), "names": pa.large_string()}
    batch = pa.RecordBatch.from_pydict({
        name: pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), pa.array(values, kinds.get(name)))
        for name, values in arrays.items()
    })
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def opened(data):
    """The automaton of a packed stream, its arrays in place."""
    import pyarrow as pa

    batch = pa.ipc.open_stream(data).read_next_batch()
    columns = {name: batch.column(name).values for name in batch.schema.names}
    return Automaton({
        name: values.to_pylist() if name in ("words", "names") else values.to_numpy() for name, values in columns.items()})


def scan(texts, machine):
    """(number of words, [from, to) runs of the hit words, items) of every text; all are scanned together.

    Without a machine there are no hits.
    """
    number = machine.number if machine else {}
    numbers = [np.fromiter((number.get(w, -1) for w in normal_words(text)), np.int32) for text in texts]
    sizes = np.array([len(n) for n in numbers], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # one place that is no word lies between texts
    flat = np.full(int((sizes + 1).sum()), -1, np.int32)
    for start, n in zip(starts, numbers):
        flat[start : start + len(n)] = n
    runs, items = [[] for _ in texts], [set() for _ in texts]
    ends, nodes = machine.found(flat) if machine else ((), ())
    if len(ends):
        steps = np.zeros(len(flat) + 1, np.int64)
        np.add.at(steps, ends + 1 - np.searchsorted(machine.levels, nodes), 1)
        np.add.at(steps, ends + 1, -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(steps) > 0).view(np.int8), [0]))))
        at = np.searchsorted(starts, edges[::2], "right") - 1
        for k, a, b in zip(at, edges[::2] - starts[at], edges[1::2] - starts[at]):
            runs[k].append([int(a), int(b)])
        pairs = np.unique(np.stack((np.searchsorted(starts, ends, "right") - 1, machine.window[nodes])), axis=1)
        for k, w in pairs.T:
            items[k].update(machine.items[machine.bounds[w] : machine.bounds[w + 1]].tolist())
    return [(int(n), r, sorted(machine.names[i] for i in found)) for n, r, found in zip(sizes, runs, items)]


def hit_spans(text, runs):
    """Spans [start, end) of code points of the original text for runs [from, to) of words."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    point = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in runs]


def _publish(table):
    """Build the automaton of one part; the rows hold it in pieces."""
    import pyarrow as pa

    data = packed(build(table.column("window"), table.column("items"))).to_pybytes()
    cuts = range(0, len(data), PIECE_BYTES)
    return pa.table({
        "part": pa.array([table.column("part")[0].as_py()] * len(cuts), pa.int32()),
        "nth": pa.array(range(len(cuts)), pa.int32()),
        "piece": pa.array([data[at : at + PIECE_BYTES] for at in cuts], pa.binary()),
    })


def _parts(benchmark):
    """Automata of about AUTOMATON_BYTES of windows each, built by tasks, published as a table, sent to all executors."""
    spark = benchmark.sparkSession
    found = staged(windows(benchmark), "windows")
    size = found.agg(F.sum(F.octet_length("window") + 16 * F.size("items"))).first()[0] or 0
    count = max(1, -(-size // AUTOMATON_BYTES))
    part = F.pmod(F.xxhash64("window"), F.lit(count)).cast("int").alias("part")
    pieces = staged(found.select(part, "window", "items").groupBy("part").applyInArrow(
        _publish, "part int, nth int, piece binary"), "automata")
    parts = []
    for (k,) in sorted(pieces.select("part").distinct().toLocalIterator()):
        rows = sorted(pieces.where(F.col("part") == k).select("nth", "piece").toLocalIterator())
        parts.append(spark.sparkContext.broadcast(b"".join(bytes(r.piece) for r in rows)))
    return parts


def _blocks(texts):
    """Ranges of rows of about BLOCK_CHARS together."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= BLOCK_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scanner(part):
    """Scan with one automaton: adds ``n_words``, ``hits`` ([from, to) of words) and ``items`` to a batch."""

    def run(batches):
        import pyarrow as pa

        machine = opened(part.value) if part else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _blocks(texts):
                counts, hits, items = zip(*scan(texts[start:end], machine))
                columns = [batch.column(i).slice(start, end - start) for i in range(batch.num_columns)] + [
                    pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))),
                    pa.array(items, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_words", "hits", "items"])

    return run


def _scanned(docs, part):
    schema = docs.schema.simpleString()[len("struct<"):-1]
    return docs.mapInArrow(
        _scanner(part), f"{schema},n_words:bigint,hits:array<array<bigint>>,items:array<string>"
    )


def contaminated(docs, benchmark, carry=()):
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every row.

    ``hits`` has the hit runs as [from, to) of words; ``carry`` names further columns of ``docs`` to keep
    beside the result. A benchmark beyond one automaton's size is scanned for part by part, and the hits
    of a row are then merged.
    """
    parts = _parts(benchmark)
    rows = docs.select("doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    if len(parts) < 2:
        found = _scanned(rows, parts[0] if parts else None)
    else:
        rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        each = None
        for part in parts:
            one = _scanned(rows.select("_row", "text"), part).drop("text")
            each = one if each is None else each.unionByName(one)
        merged = each.groupBy("_row").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).withColumn("hits", _joined_runs("hits"))
        found = rows.join(merged, "_row").drop("_row")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    kept = [c for c in carry if c != "doc_id"]
    return found.select(
        "doc_id", *kept, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "hits",
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _joined_runs(name):
    """Runs [from, to) with overlapping ones joined."""
    step = F.aggregate(
        F.sort_array(name), F.array().cast("array<array<bigint>>"),
        lambda done, run: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)[1] >= run[0]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], run[1]))),
            ),
        ).otherwise(F.concat(done, F.array(run))),
    )
    return step


def op8_decontaminate(spark, folder):
    """The contract's columns for all of ``documents`` against all of ``benchmark``."""
    return contaminated(load(spark, folder, "documents"), load(spark, folder, "benchmark")).drop("hits")


OP8_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS g, least(len(w), 10) AS k
  FROM b, generate_series(0, greatest(len(b.w) - 10, 0)) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM d, sizes, generate_series(0, len(d.w) - sizes.k) AS s(i) WHERE len(w) >= k),
occ AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN win USING (g)),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ),
nh AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
ni AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(ni.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
