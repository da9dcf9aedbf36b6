r"""URL filters by a cascade of Bloom filters.

A cascade answers exactly whether a key is listed, for every key of the corpus, and is a few bitmaps instead of a
table to join. Level 1 encodes the listed keys. Over the complete key universe of the corpus it lets through some
keys that are not listed; level 2 encodes these. It lets through some listed keys, which level 3 encodes, and
so on until a level lets nothing wrong through. A key that a level stops is decided there: an odd level says
that it is not listed, an even one that it is; a key that all levels let through is one of the last level's.

Keys are cut into parts by their hash, so that the bitmaps of one part stay below ``PART_BYTES``. Parts are tested
one after the other, with the best hit carried on in a staged table of narrow rows, so that no plan holds more
than one part, however long the lists are; a list of one part takes one pass.

A url is judged by the longest rule that fits it, found by testing its candidate keys (endings of the host
by starts of the path) in the cascade of the rules' keys; whether that rule blocks is asked of a second cascade.
A url without rule is blocked if an ending of its host is in the block list, which the second cascade holds too.

Everything is DataFrame functions. Building reads the urls once for each part and cascade; only keys that pass level 1
are exchanged, each once per task. A frequent host is a frequent row of a scan and no group.

Defined results: a NULL url, or one without ``://``, has an empty host and path, no rule and is allowed; only A-Z is
lower-cased; of rules of equal length the one of the longer host wins; a rule that is in both lists blocks; rules and list entries
that are NULL are ignored; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

import string

from pyspark.sql import functions as F

from tablekeeper.llm.tables import let, load, staged

#: Largest size of the bitmaps of one part of level 1.
PART_BYTES = 1 << 20
#: Bits a key and hashes of level 1 (1 of 2,000 other keys passes), and bits a key of the further levels.
FIRST_BITS, FIRST_HASHES = 16, 8
FURTHER_BITS = 4
#: Bits of the bitmaps that Spark's bitmap functions make.
BUCKET = 32768
MOST_LEVELS = 64

RULES = [  # (host and path, verdict), fixed values
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: A host is listed if a label of it, cut at hyphens, has one of these words.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


# --- the cascade -----------------------------------------------------------------------------------

def _positions(key, level, bits, hashes):
    """Bit numbers of ``key`` in a bitmap of ``bits`` bits."""
    first = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(2 * level + 1), key), F.lit(bits))
    return F.array(*[F.pmod(first + k * step, F.lit(bits)) for k in range(hashes)])


def _bit(bitmap, at):
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


class Level:
    """One Bloom filter: its bitmap, and how keys are hashed into it."""

    def __init__(self, number, bits, hashes, bitmap):
        self.number, self.bits, self.hashes, self.bitmap = number, bits, hashes, bitmap

    def passes(self, key):
        bitmap = F.lit(self.bitmap)
        return F.forall(_positions(key, self.number, self.bits, self.hashes), lambda at: _bit(bitmap, at))


def build_level(keys, count, number, bits_per_key, hashes):
    """The filter of the distinct ``key`` values of ``keys``; ``count`` of them at most."""
    bits = BUCKET * max(1, -(-count * bits_per_key // BUCKET))
    at = keys.select(F.explode(_positions(F.col("key"), number, bits, hashes)).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("at") % BUCKET).cast("long")).alias("bitmap")).collect()
    bitmap = bytearray(bits // 8)
    for row in rows:
        bitmap[row.bucket * BUCKET // 8:(row.bucket + 1) * BUCKET // 8] = row.bitmap
    return Level(number, bits, hashes, bytes(bitmap))


def _contains(levels, key):
    """Whether ``key`` is listed, by the levels of its part."""
    listed = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        listed = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(listed)
    return listed


class Cascade:
    """Exact membership of keys of one universe, part by part."""

    def __init__(self, parts):
        self.parts = parts

    def contains(self, key, part):
        """Whether ``key`` is listed, where it belongs to the part of that number; else False."""
        levels = self.parts[part]
        here = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(len(self.parts))) == part
        return here & _contains(levels, key) if levels else F.lit(False)


def build_cascade(listed, universe, name, part_bytes=PART_BYTES):
    """The cascade of the ``key`` values of ``listed`` over those of ``universe``; either may repeat its keys."""
    listed = staged(listed.select("key").where("key IS NOT NULL").distinct(), f"{name}-listed")
    total = listed.count()
    n = max(1, -(-total * FIRST_BITS // (8 * part_bytes)))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(n))
    parts = []
    for i in range(n):
        wanted = listed.where(part == i)
        count = wanted.count()
        if not count:
            parts.append([])
            continue
        levels = [build_level(wanted, count, 1, FIRST_BITS, FIRST_HASHES)]
        passed = universe.select("key").where((part == i) & levels[0].passes(F.col("key")))
        # Keys that are not listed come from the universe alone.
        both = wanted.withColumn("listed", F.lit(1)).unionByName(passed.withColumn("listed", F.lit(0)))
        known = staged(both.groupBy("key").agg((F.max("listed") == 1).alias("listed")), f"{name}-known")
        while True:
            # The wrong ones pass all levels and are not what the last level encodes.
            wrong = known.where(F.col("listed") == (len(levels) % 2 == 0))
            for level in levels[1:]:
                wrong = wrong.where(level.passes(F.col("key")))
            left = wrong.count()
            if not left:
                break
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys share all their hashes")
            levels.append(build_level(wrong, left, len(levels) + 1, FURTHER_BITS, 1))
        parts.append(levels)
    return Cascade(parts)


# --- urls ------------------------------------------------------------------------------------------

def _lower(text):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url):
    return _lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def endings(host, depth):
    """The endings of ``host`` at its labels, of ``depth`` labels at most, the longest first."""
    return let(F.split(host, r"\."), lambda labels: F.transform(
        F.sequence(F.least(F.size(labels), F.lit(depth)), F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    ))


def rule_keys(host, path, depth, lengths):
    """All rules that could fit, the longest first: endings of the host by starts of the path of these lengths."""
    lengths = F.array(*[F.lit(n) for n in sorted(lengths)])
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(endings(host, depth), lambda e: F.transform(starts, lambda s: F.struct(
        F.length(F.concat(e, s)).alias("size"), F.length(e).alias("of_host"), F.concat(e, s).alias("key")))))
    return F.transform(F.sort_array(pairs, asc=False), lambda x: x["key"])


def values(spark, names, rows):
    """A small table of strings as a DataFrame."""
    cells = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row)]) for row in rows])
    empty = F.array().cast(f"array<struct<{', '.join(f'{n}: string' for n in names)}>>")
    return spark.range(1).select(F.explode(cells if rows else empty).alias("x")).select("x.*")


def judge(pages, rules, listed, key_column="page_id", part_bytes=PART_BYTES):
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` has (``rule``: host and path prefix, the path from the first slash on; ``verdict``: allow or block)
    and ``listed`` has ``host``: hosts blocked with all their subdomains where no rule fits. Both may be long.
    """
    rules = rules.where("rule IS NOT NULL AND verdict IN ('allow', 'block')")
    listed = listed.where("host IS NOT NULL").select(_lower(F.col("host")).alias("host"))
    rule_host = F.substring_index("rule", "/", 1)
    labels = F.size(F.split(F.col("host"), r"\."))
    # Lengths of rules' paths are few: no more than the longest one has characters.
    lengths = [r.n for r in rules.select(
        (F.length("rule") - F.length(rule_host)).alias("n")).distinct().collect()]
    depth = rules.select(rule_host.alias("host")).agg(F.max(labels)).first()[0] or 1
    listed_depth = listed.agg(F.max(labels)).first()[0] or 1

    url = F.col("url")
    urls = pages.select(F.col(key_column), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    keys = rule_keys(host, path, depth, lengths) if lengths else F.array().cast("array<string>")
    ends = endings(host, listed_depth)
    of_rule, of_host = (lambda k: F.concat(F.lit("r"), k)), (lambda h: F.concat(F.lit("h"), h))

    fits = build_cascade(
        rules.select(F.col("rule").alias("key")), urls.select(F.explode(keys).alias("key")), "rules", part_bytes)
    blocks = build_cascade(
        rules.where("verdict = 'block'").select(of_rule(F.col("rule")).alias("key")).unionByName(
            listed.select(of_host(host).alias("key"))),
        urls.select(F.explode(F.transform(ends, of_host)).alias("key")).unionByName(
            rules.select(of_rule(F.col("rule")).alias("key"))), "blocked", part_bytes)

    def better(part):
        hit = F.get(F.filter(keys, lambda k: fits.contains(k, part)), F.lit(0))
        if not part:
            return hit
        # Of two parts' hits the one that comes first among the keys.
        return F.get(F.filter(keys, lambda k: k.eqNullSafe(hit) | k.eqNullSafe(F.col("rule"))), F.lit(0))

    out = urls
    for part in range(len(fits.parts)):
        out = out.withColumn("rule", better(part))
        if len(fits.parts) > 1:
            out = staged(out, "ruled")
    for part in range(len(blocks.parts)):
        hit = F.when(F.col("rule").isNotNull(), blocks.contains(of_rule(F.col("rule")), part)).otherwise(
            F.exists(ends, lambda e: blocks.contains(of_host(e), part)))
        out = out.withColumn("blocked", hit | F.col("blocked") if part else hit)
        if len(blocks.parts) > 1:
            out = staged(out, "blocked")
    return out.select(
        key_column, "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))


def listed_hosts(pages, words=LISTED_WORDS):
    """Distinct hosts of ``pages`` that have one of ``words`` as a hyphenated piece of a label."""
    pieces = F.split(F.col("host"), r"[.-]")
    return pages.select(host_of(F.col("url")).alias("host")).where(
        F.arrays_overlap(pieces, F.array(*[F.lit(w) for w in words]))).distinct()


def op12_url_filter(spark, folder):
    """The contract's columns for all of ``pages``, with the block list that ``listed_hosts`` takes from them."""
    pages = load(spark, folder, "pages")
    return judge(pages, values(spark, ["rule", "verdict"], RULES), listed_hosts(pages))


OP12_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.*, (
    SELECT max_by({'rule': rh || rp, 'v': v}, length(rh || rp)) FROM r
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS x
  FROM u)
SELECT page_id, host, path, x.rule AS rule,
  coalesce(x.v, CASE WHEN list_has_any(string_split_regex(host, '[.-]'),
    ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']) THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
