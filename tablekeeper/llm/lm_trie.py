"""Language-model scoring with published Elias-Fano coded n-gram tries.

A bigram model with Dirichlet smoothing: p(w | v) = (c(v, w) + m * p1(w)) / (c(v) + m) with
p1(w) = (c(w) + 1) / (N + V + 1). The log of a text is a sum over its tokens of log(c(v, w) + m * p1(w)),
which needs counts of w and (v, w) only, less a sum over its words v of log(c(v) + m). So the trie is cut
into shards by the predicted word; a word so frequent that it would fill a shard is cut by its context.

``train`` sends the distinct pairs of each block of training tokens to their shards, builds one trie (see
``elias_fano``) per shard and publishes all as a table in a folder, which serves any number of later runs
(``open_model``). ``score`` sends the tokens of the documents to score, packed per block and shard, to tasks
that map the stored trie of their shard and walk the blocks one by one: each distinct pair of a block is one
look-up, whether or not its document took part in training. The sums go back per block of documents.
Longer n-grams would need one more exchange of all tokens each time, see the README.

Probabilities are stored as 16-bit codes of their logs in steps of ``STEP``. Sums are of whole numbers, so
that reruns agree.

Defined results: NULL text is empty and has one token, the end; a NULL id trains; repeated rows count and are
scored each; without training documents N = V = 0; an empty table gives no rows; other columns are ignored.
"""

from typing import NamedTuple

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablekeeper.llm import hashing
from tablekeeper.llm.elias_fano import BigramTrie
from tablekeeper.llm.tables import load, staged
from tablekeeper.session import work_dir

HELD_OUT = (7, 2)
MASS = 1000.0
#: Training tokens aimed at for one shard of the trie.
SHARD_TOKENS = 4_000_000
#: Pairs of blocks that a task looks up together, each distinct one once, and sums per document that it keeps
#: before it sends them on.
ASKED = 1 << 21
WAITING = 1 << 20
#: Bits of the hash that tells a word's contexts apart.
CONTEXT_BITS = 40
LOWEST, STEP = -20.0, 40.0 / 65536
FIXED = float(1 << 36)
START, END = (hashing.mixed(np.array([k], np.uint64))[0] for k in (0x5354415254, 0x454E44))
_BLOCK = 1 << 20
#: Bits of the row number within one block of documents whose sums meet in one task.
_MEET = 10
_SUMS = (np.int64,) * 4
_COUNTED = 4 << 20


def codes_of(logs):
    """16-bit codes of logs."""
    return np.clip(np.round((logs - LOWEST) / STEP), 0, 65535).astype(np.uint16)


def _tokens(column):
    """(tokens, contexts, row) of all rows of a column: each text's words and its end."""
    words, bounds = hashing.word_hashes(column)
    n = len(bounds) - 1
    sizes = np.diff(bounds) + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end] = END
    tokens[~is_end] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - sizes + 1] = START
    return tokens, before, np.repeat(np.arange(n), sizes)


def _prepared(docs):
    divisor, remainder = HELD_OUT
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.coalesce(held, F.lit(False)).alias("held_out"), "text",
    )


def word_counts(docs):
    """(``word``, ``n``): tokens of the training documents by hash."""

    def run(batches):
        import pyarrow as pa

        def counted(parts):
            words, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        parts, size = [], 0
        for batch in hashing.small_batches(batches):
            parts.append(_tokens(batch.column("text"))[0])
            size += len(parts[-1])
            if size >= _COUNTED:
                yield counted(parts)
                parts, size = [], 0
        if parts:
            yield counted(parts)

    rows = _prepared(docs).where(~F.col("held_out")).select("text").mapInArrow(run, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# --- blocks of tokens per shard ------------------------------------------------------------------

def _pack(arrays):
    import zstandard

    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


_PAIRS = (np.uint64, np.uint32, np.uint32, np.uint8, np.uint32)
_QUERIES = (*_PAIRS, np.uint32, np.uint32, np.int64)


def _unpack(blob, types):
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(data, np.int64, len(types))
    at, out = head.nbytes, []
    for n, kind in zip(head, types):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _runs(values):
    """[from, to) of equal neighbours."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return zip(edges, np.append(edges[1:], len(values)))


def _units(tokens, before, shards, hot):
    """(shard, word) of the distinct ones of a block by shard, and each token's place among them."""
    words, number = np.unique(tokens, return_inverse=True)
    part = np.zeros(len(tokens), np.uint64)
    if len(hot["word"]):  # a frequent word is cut by its contexts
        at = np.minimum(np.searchsorted(hot["word"], words), len(hot["word"]) - 1)
        cuts = np.where(hot["word"][at] == words, hot["cuts"][at], np.uint64(1))
        part = hashing.mixed(before) % cuts[number]
    shard = hashing.mixed(tokens + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)
    units, rank = np.unique(shard.astype(np.int64) * len(words) + number, return_inverse=True)
    return units // len(words), words[units % len(words)], rank


def _split(contexts):
    """Contexts as 32 low bits and the rest."""
    return (contexts & np.uint64(0xFFFFFFFF)).astype(np.uint32), (contexts >> np.uint64(32)).astype(np.uint8)


def _joined(low, top):
    return low.astype(np.uint64) | (top.astype(np.uint64) << np.uint64(32))


def _contexts(before):
    return np.unique(before >> np.uint64(64 - CONTEXT_BITS), return_inverse=True)


def _pairs(tokens, before, shards, hot):
    """(shard, blob): the distinct pairs of a block with their counts."""
    shard, word, rank = _units(tokens, before, shards, hot)
    seen, context = _contexts(before)
    pair, times = np.unique(rank * len(seen) + context, return_counts=True)
    unit, contexts = pair // len(seen), seen[pair % len(seen)]
    for a, b in _runs(shard[unit]):
        units, sizes = np.unique(unit[a:b], return_counts=True)
        yield int(shard[units[0]]), _pack((
            word[units], sizes.astype(np.uint32), *_split(contexts[a:b]), times[a:b].astype(np.uint32)))


def _queries(tokens, before, rows, ids, shards, hot):
    """(shard, blob): the distinct pairs of a block, and which documents have them how often."""
    shard, word, rank = _units(tokens, before, shards, hot)
    seen, context = _contexts(before)
    c_bits, d_bits = int(len(seen)).bit_length(), int(rows[-1] - rows[0] + 1).bit_length()
    joint = (rank << (c_bits + d_bits)) | (context << d_bits) | (rows - rows[0])
    joint, times = np.unique(joint, return_counts=True)
    pair, doc = joint >> d_bits, joint & ((1 << d_bits) - 1)
    new_pair = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    post_at = np.append(new_pair, len(pair))
    pair_size = np.diff(post_at)
    pair = pair[new_pair]
    unit, contexts = pair >> c_bits, seen[pair & ((1 << c_bits) - 1)]
    for a, b in _runs(shard[unit]):
        units, sizes = np.unique(unit[a:b], return_counts=True)
        lo, hi = post_at[a], post_at[b]
        docs, local = np.unique(doc[lo:hi], return_inverse=True)
        yield int(shard[units[0]]), _pack((
            word[units], sizes.astype(np.uint32), *_split(contexts[a:b]), pair_size[a:b].astype(np.uint32),
            local.astype(np.uint32), times[lo:hi].astype(np.uint32), ids[docs + rows[0]],
        ))


# --- training ------------------------------------------------------------------------------------

class Model(NamedTuple):
    """A published model: ``tries`` has (``shard``, ``blob``), ``hot`` words cut over shards."""

    tries: object
    hot: dict
    shards: int
    total: int
    distinct: int
    trained: int


def _sent_to(df, shards):
    """Rows of ``df`` in one partition per shard, ordered."""
    tasks = max(12, shards)
    return df.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "kind")


def _trie(blobs, hot, total, distinct):
    """The trie of one shard from the pairs of all blocks."""
    blocks = [_unpack(b, _PAIRS) for b in blobs]
    words = np.unique(np.concatenate([b[0] for b in blocks]))
    keys = np.concatenate([
        (np.repeat(np.searchsorted(words, units), sizes).astype(np.uint64) << np.uint64(CONTEXT_BITS))
        | _joined(low, top) for units, sizes, low, top, _ in blocks])
    pairs, inverse = np.unique(keys, return_inverse=True)
    times = np.bincount(inverse, np.concatenate([b[4] for b in blocks]), len(pairs)).astype(np.int64)
    parents = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    counts = np.bincount(parents, times, len(words)).astype(np.int64)
    if len(hot["word"]):  # their other parts are in other shards
        at = np.minimum(np.searchsorted(hot["word"], words), len(hot["word"]) - 1)
        counts = np.where(hot["word"][at] == words, hot["n"][at], counts)
    prior = MASS * (counts + 1) / (total + distinct + 1)
    return BigramTrie(
        words, counts, codes_of(np.log10(prior)), codes_of(np.log10(counts + MASS)), parents,
        pairs & np.uint64((1 << CONTEXT_BITS) - 1), codes_of(np.log10(times + prior[parents])), CONTEXT_BITS,
    )


def train(docs, shard_tokens=SHARD_TOKENS, path=None):
    """Learn from the training documents of ``docs`` and publish the model at ``path``."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "trie")
    words = staged(word_counts(docs), "words")
    end = int(np.array([END]).view(np.int64)[0])
    total, distinct, trained = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("n"))), F.lit(0)),
    ).first()
    shards = max(12, -(-total // shard_tokens))
    # At most two words for each shard's worth of tokens can be this frequent.
    half = shard_tokens // 2
    words.where(F.col("n") > half).select(
        "word", "n", F.ceil(F.col("n") / half).alias("cuts")).write.parquet(f"{path}/hot")
    spark.createDataFrame(
        [(shards, total, distinct, trained)], "shards long, total long, distinct long, trained long",
    ).coalesce(1).write.parquet(f"{path}/size")
    shared = spark.sparkContext.broadcast(_hot(spark, path))

    def paired(batches):
        import pyarrow as pa

        for batch in hashing.small_batches(batches):
            tokens, before, _ = _tokens(batch.column("text"))
            found = [x for at in range(0, len(tokens), _BLOCK) for x in _pairs(
                tokens[at:at + _BLOCK], before[at:at + _BLOCK], shards, shared.value)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())],
                    ["shard", "blob"])

    def built(batches):
        import pyarrow as pa

        def row(shard, blobs):
            trie = _trie(blobs, shared.value, total, distinct).stored()
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([trie], pa.binary())], ["shard", "blob"])

        held, blobs = None, []
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
                if shard != held and blobs:
                    yield row(held, blobs)
                    blobs = []
                held = shard
                blobs.append(blob.as_py())
        if blobs:
            yield row(held, blobs)

    pairs = _prepared(docs).where(~F.col("held_out")).select("text").mapInArrow(paired, "shard long, blob binary")
    _sent_to(pairs.withColumn("kind", F.lit(1)), shards).select("shard", "blob").mapInArrow(
        built, "shard long, blob binary").write.parquet(f"{path}/tries")
    return open_model(spark, path)


def _hot(spark, path):
    rows = spark.read.parquet(f"{path}/hot").collect()
    word = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(word)
    return {"word": word[order], "n": np.array([r["n"] for r in rows], np.int64)[order],
            "cuts": np.array([r["cuts"] for r in rows], np.uint64)[order]}


def open_model(spark, path):
    """The model published at ``path``."""
    size = spark.read.parquet(f"{path}/size").first()
    tries = spark.read.schema("shard long, blob binary").parquet(f"{path}/tries")
    return Model(tries, _hot(spark, path), *size)


# --- scoring -------------------------------------------------------------------------------------

def _asked(docs, model, hot):
    """Rows (``shard``, ``blob``) of queries, and one row per document with its id and token count."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = model.shards

    def run(batches):
        import pyarrow as pa

        for batch in hashing.small_batches(batches):
            tokens, before, rows = _tokens(batch.column("text"))
            ids = batch.column("row").to_numpy()
            names, blobs = [], []
            for at in range(0, len(tokens), _BLOCK):
                cut = slice(at, at + _BLOCK)
                for shard, blob in _queries(tokens[cut], before[cut], rows[cut], ids, shards, hot.value):
                    names.append(shard)
                    blobs.append(blob)
            n = len(ids)
            none = pa.nulls(len(blobs))
            out = ["shard", "blob", "doc_id", "row", "held_out", "n_tokens"]
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int64()), pa.array(blobs, pa.binary()),
                pa.nulls(len(blobs), batch.schema.field("doc_id").type), none.cast(pa.int64()),
                none.cast(pa.bool_()), none.cast(pa.int64()),
            ], out)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids % shards), pa.nulls(n, pa.binary()), batch.column("doc_id"), pa.array(ids),
                batch.column("held_out"), pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
            ], out)

    return _prepared(docs).mapInArrow(
        run, f"shard long, blob binary, doc_id {kind}, row long, held_out boolean, n_tokens long")


def _answered(blocks, trie, total, distinct):
    """(row, known tokens, fixed sum of base logs, sum of codes) for each of some blocks of queries of a shard."""
    words = np.unique(np.concatenate([b[0] for b in blocks]))
    number = np.full(len(words), -1) if trie is None else trie.find_words(words)
    keys = np.concatenate([
        (np.repeat(np.searchsorted(words, units), sizes).astype(np.uint64) << np.uint64(CONTEXT_BITS))
        | _joined(low, top) for units, sizes, low, top, *_ in blocks])
    pairs, inverse = np.unique(keys, return_inverse=True)
    parent = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    word = number[parent]
    known = word >= 0
    count = np.zeros(len(pairs), np.int64)
    code = np.full(len(pairs), codes_of(np.log10(MASS / (total + distinct + 1))), np.int64)
    weight = np.full(len(pairs), codes_of(np.log10(MASS)), np.int64)
    if known.any():
        count[known] = trie.counts[word[known]]
        code[known] = trie.find(word[known], pairs[known] & np.uint64((1 << CONTEXT_BITS) - 1))
        weight[known] = trie.weights[word[known]]
    # Every word is the context of the token after it; the end is none's.
    code -= np.where(words[parent] == END, 0, weight)
    base = np.round(np.log10(count + 1.0) * FIXED)
    at = 0
    for *_, pair_size, local, times, ids in blocks:
        mine = np.repeat(inverse[at:at + len(pair_size)], pair_size)
        at += len(pair_size)
        yield ids, *(np.bincount(local, times * x[mine], len(ids)).astype(np.int64)
                     for x in (known.astype(float), base, code.astype(float)))


def score(docs, shard_tokens=SHARD_TOKENS, model=None):
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` by a
    published model, or by one learnt from the training documents of ``docs``."""
    spark = docs.sparkSession
    model = model or train(docs, shard_tokens)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hot = spark.sparkContext.broadcast(model.hot)
    total, distinct = model.total, model.distinct
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("doc_id", id_type), ("row", pa.int64()),
                            ("held_out", pa.bool_()), ("n_tokens", pa.int64())])

        def merged(sums):
            ids, inverse = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
            out = [np.zeros(len(ids), np.int64) for _ in range(3)]
            for k in range(3):
                np.add.at(out[k], inverse, np.concatenate([x[k + 1] for x in sums]))
            cuts = list(_runs(ids >> _MEET))
            blobs = [_pack([x[a:b] for x in (ids, *out)]) for a, b in cuts]
            return pa.RecordBatch.from_arrays([
                pa.array([ids[a] >> _MEET for a, _ in cuts], pa.int64()), pa.array(blobs, pa.binary()),
                *(pa.nulls(len(blobs), f.type) for f in list(schema)[2:])], schema=schema)

        held, trie, blocks, asked, waiting, size = None, None, [], 0, [], 0
        for batch in batches:
            blobs = batch.column("blob")
            own = batch.filter(blobs.is_null())
            n = own.num_rows
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.column("row").to_numpy() >> _MEET), pa.nulls(n, pa.binary()),
                     *(own.column(c).cast(schema.field(c).type) for c in ("doc_id", "row", "held_out", "n_tokens"))],
                    schema=schema)
            for shard, what, blob in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), blobs):
                if not blob.is_valid:
                    continue
                if blocks and (shard != held or asked >= ASKED):
                    waiting += _answered(blocks, trie, total, distinct)
                    size += sum(len(x[0]) for x in waiting[-len(blocks):])
                    blocks, asked = [], 0
                    if size >= WAITING:
                        yield merged(waiting)
                        waiting, size = [], 0
                if shard != held:
                    held, trie = shard, None
                if what == 0:
                    trie = BigramTrie.mapped(blob.as_buffer())
                else:
                    blocks.append(_unpack(blob.as_py(), _QUERIES))
                    asked += len(blocks[-1][4])
        if blocks:
            waiting += _answered(blocks, trie, total, distinct)
        if waiting:
            yield merged(waiting)

    asked = _asked(docs, model, hot).withColumn("kind", F.lit(1))
    tries = model.tries.withColumn("kind", F.lit(0))
    parts = _sent_to(asked.unionByName(tries, allowMissingColumns=True), model.shards).mapInArrow(
        run, f"block long, sums binary, doc_id {kind}, row long, held_out boolean, n_tokens long")

    def meet(table):
        import pyarrow as pa

        blobs = table.column("sums").combine_chunks()
        own = table.filter(blobs.is_null()).sort_by("row")
        ids = own.column("row").to_numpy()
        out = [np.zeros(len(ids), np.int64) for _ in range(3)]
        for blob in blobs.drop_null():
            rows, *sums = _unpack(blob.as_py(), _SUMS)
            for total_, part in zip(out, sums):
                total_[np.searchsorted(ids, rows)] += part
        return pa.table(
            [*(own.column(c) for c in ("doc_id", "held_out", "n_tokens")), *map(pa.array, out)],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "code"])

    sums = parts.groupBy("block").applyInArrow(
        meet, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base long, code long")
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") / FIXED - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("code") * STEP + (LOWEST - float(np.log10(model.trained + MASS)))).alias("score"),
    )


def op2_lm_score(spark, folder):
    """The contract's columns for all of ``documents``."""
    return score(load(spark, folder, "documents"))
