"""Personal data: base patterns, and gradient-boosted candidates beside them.

Base spans are those of four fixed patterns with their checks. Generators of high recall propose further,
overlapping spans of the same kinds. Each candidate has a few discrete features of its format and context. A
boosted ensemble of small trees scores it, and a threshold per kind, calibrated on documents that the trees
have not seen, selects it. Selected candidates that touch no base span and no better candidate are added.

There are no labels of spans. A candidate that touches a base span of its kind counts as personal data; one that
lies within a base span of another kind, breaks the format of its kind (``_fits``), or stands behind a word that names
another number, such as an invoice or a lot (``_OTHER``), as not. All others are unlabelled: the trees and thresholds
do not see them. Which candidates are added is up to trees and threshold alone. A corpus without base spans of a kind, or
without two halves of ids, gives no model of it, and nothing of that kind is added. The trees see the counts of each feature vector over all candidates of all documents: the
vectors are few, as every feature has few values (``VALUES``), so the table that reaches the driver is bounded.

Everything is DataFrame functions; the trees become column expressions.

Defined results: NULL text is empty and has no spans; repeated rows are treated each; other columns are
ignored; an empty table gives no rows, and without candidates nothing is added.
"""

import math

from pyspark.sql import functions as F

from tablekeeper.llm.tables import let, load

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Quantifiers that cannot give back change no match, and a run is entered at
# its start or where the match before ended, so that long runs take linear time.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Generators of candidates: wider than the base patterns.
WIDE = {
    "email": r"(?:\G|(?<![^\x20\x09-\x0D@<>()\[\],;:\x22]))[^\x20\x09-\x0D@<>()\[\],;:\x22]++"
             r"(?:@|\x20?[\[(]at[\])]\x20?)[^\x20\x09-\x0D@<>()\[\],;:\x22]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:\x20?[.,]\x20?[0-9]{1,3}+){3}",
    "card": r"(?:\G|(?<![0-9]))(?:[0-9]{3,6}+(?:[\x20./-][0-9]{3,6}+){2,4}|[0-9]{14,19}+)",
    "phone": r"(?:\G|(?<![0-9]))\(?[0-9]{2,4}+\)?(?:[\x20./-]{1,2}+[0-9]{2,4}+){2,4}",
}
#: Formats that candidates must keep, and shapes of numbers that are no phones: dates, years, addresses.
_MAIL = r"^[\p{L}\p{N}._%+-]+(?:@|\x20?[\[(]at[\])]\x20?)(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}\.?$"
_ADDRESS = rf"^{_BYTE}(?:\x20?\.\x20?{_BYTE}){{3}}$"
_YEAR = "(?:19|20)[0-9]{2}"
_NO_PHONE = (rf"{_YEAR}[./-][01][0-9][./-][0-3][0-9]|[0-3][0-9][./-][01][0-9][./-]{_YEAR}|^{_YEAR}(?:[\x20./-]+{_YEAR})+$"
             r"|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
CONTEXT = 24
#: Words before a number that name something else.
_OTHER = r"(?i)(?:invoice|order|lot|batch|serial|ref|version|release|isbn|part|item)(?:\s*(?:no|nr|number|id))?[\s.:#-]*$"
_CUES = {
    "email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|pay|credit",
    "phone": r"(?i)tel|phone|call|fax|mobile",
}
#: Values that each feature may take, beside the kind.
VALUES = {"digits": 6, "signs": 4, "round": 2, "luhn": 2, "dots": 4, "ending": 2, "cue": 2, "other": 2, "left": 2,
          "right": 2}
ROUNDS, RATE, LEAST_PRECISION = 24, 0.4, 0.95
_SPAN = "array<struct<s:bigint,e:bigint,m:string>>"


def found(text, pattern):
    """Array of (``s``, ``e``, ``m``) of the leftmost non-overlapping matches, in code points.

    The text between the matches gives the gaps; their running sums are taken in stretches of 256 matches.
    """
    step = 256

    def spans(z):
        def stretch(c):
            before = F.aggregate(F.slice(z, 1, c * step), F.lit(0).cast("bigint"),
                                 lambda at, x: at + x["gap"] + x["n"])
            return F.aggregate(
                F.slice(z, c * step + 1, F.lit(step)),
                F.struct(before.alias("at"), F.array().cast(_SPAN).alias("out")),
                lambda st, x: F.struct(
                    (st["at"] + x["gap"] + x["n"]).alias("at"),
                    F.concat(st["out"], F.array(F.struct(
                        (st["at"] + x["gap"]).alias("s"), (st["at"] + x["gap"] + x["n"]).alias("e"),
                        x["m"].alias("m")))).alias("out")),
            )["out"]

        return F.flatten(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(z) - 1) / step).cast("int")), stretch))

    def with_gaps(matches):
        return let(F.split(text, pattern, -1), lambda p: F.transform(matches, lambda m, i: F.struct(
            F.length(F.get(p, i)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("n"), m.alias("m"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda matches: F.when(
        F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(let(with_gaps(matches), spans)))


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits has a right check digit."""
    def value(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def base_spans(text, kind):
    """Valid base spans of one kind."""
    spans = found(text, BASE[kind])
    if kind == "ip":
        return F.filter(spans, lambda x: x["m"].rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))
    if kind == "card":
        # Shorter runs, which most numbers are, need not be located beyond their length.
        return F.filter(spans, lambda x: let(_digits(x["m"]), lambda d: F.when(
            F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))))
    if kind == "phone":
        return F.filter(spans, lambda x: F.length(_digits(x["m"])).between(10, 15))
    return spans


def _present(text, kind):
    """Cheap condition without which a kind cannot occur."""
    return {"email": F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")),
            "phone": text.rlike("[0-9]"), "ip": text.rlike(r"[0-9]"), "card": text.rlike(r"[0-9]")}[kind]


def _before(text, x):
    return F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)).cast("int"),
                       F.least(x["s"], F.lit(CONTEXT)).cast("int"))


def _fits(text, x, kind):
    """Whether a candidate keeps the format of its kind: a mail has a host with an ending, an address four bytes,
    a card 14 to 19 digits with a right check digit; a phone 10 to 15, in signs or brackets, or by blanks alone
    behind a cue, and is no date."""
    m = x["m"]
    if kind == "email":
        return m.rlike(_MAIL)
    if kind == "ip":
        return m.rlike(_ADDRESS)
    digits = _digits(m)
    apart = ~_before(text, x).rlike(r"[\p{L}0-9]$") & ~F.substring(text, (x["e"] + 1).cast("int"), F.lit(1)).rlike(
        r"[\p{L}0-9]")
    if kind == "card":
        return apart & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return (apart & F.length(digits).between(10, 15) & ~m.rlike(_NO_PHONE) & m.rlike(r"^(?:[^()]|\([0-9]+\))*$")
            & (m.rlike("[(./-]") | _before(text, x).rlike(_CUES[kind])))


def features(text, x, kind):
    """Features of a candidate as a struct of small whole numbers."""
    m = x["m"]
    digits = _digits(m)
    n = F.length(digits)
    before = _before(text, x)
    after = F.substring(text, (x["e"] + 1).cast("int"), F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 17, 4).otherwise(5).alias("digits"),
        F.least(F.length(F.regexp_replace(m, r"[^\x20./-]", "")), F.lit(3)).alias("signs"),
        flag(F.contains(m, F.lit("("))).alias("round"),
        flag(F.when(n.between(12, 19), luhn(digits))).alias("luhn"),
        F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(3)).alias("dots"),
        flag(m.rlike(r"\.[A-Za-z]{2,6}\.?$")).alias("ending"),
        flag(before.rlike(_CUES[kind])).alias("cue"),
        flag(before.rlike(_OTHER)).alias("other"),
        flag(before.rlike(r"[\p{L}0-9+]$")).alias("left"),
        flag(after.rlike(r"[\p{L}0-9]")).alias("right"),
    )


def prepared(docs, carry=()):
    """``doc_id``, ``text``, the base spans per kind (``base``) and the candidates per kind (``more``)."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    columns = [c for c in carry if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", *columns, whole.alias("text"))
    none = F.array().cast(_SPAN)
    rows = rows.select("*", *[
        F.when(_present(F.col("text"), k), base_spans(F.col("text"), k)).otherwise(none).alias(f"base_{k}")
        for k in KINDS])

    def touches(x, spans):
        return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def within(x, kind):
        return F.exists(F.concat(*[F.col(f"base_{k}") for k in KINDS if k != kind]),
                        lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))

    def candidates(kind):
        kept = F.transform(found(F.col("text"), WIDE[kind]), lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"),
            touches(x, F.col(f"base_{kind}")).alias("is_base"), within(x, kind).alias("is_other"),
            _fits(F.col("text"), x, kind).alias("fits"), features(F.col("text"), x, kind).alias("f")))
        return F.when(_present(F.col("text"), kind), kept)

    return rows.withColumn("more", F.filter(
        F.flatten(F.array_compact(F.array(*[candidates(k) for k in KINDS]))), lambda x: x["s"].isNotNull()))


# --- boosted trees -------------------------------------------------------------------------------

def _histogram(docs):
    """Counts of (half, kind, features, is_base) over all labelled candidates; halves are by digest of the id."""
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2))
    return prepared(docs).select(half.alias("half"), F.explode("more").alias("x")).where(
        "x.is_base OR x.is_other OR NOT x.fits OR x.f.other = 1").select(
        "half", "x.kind", "x.is_base", "x.f.*").groupBy("half", "kind", "is_base", *VALUES).agg(
        F.count("*").alias("n")).collect()


def boost(rows, rounds=ROUNDS, rate=RATE):
    """Trees of two splits for rows of (features, good, bad): lists of (split, left, right), a split being
    (feature, value) and each side a split with two leaves."""
    scores, trees = [0.0] * len(rows), []
    splits = [(name, v) for name, n in VALUES.items() for v in range(1, n)]

    def gradient():
        out = []
        for (_, good, bad), s in zip(rows, scores):
            p = 1 / (1 + math.exp(-s))
            out.append((good - (good + bad) * p, (good + bad) * p * (1 - p)))
        return out

    def leaf(g, h):
        return max(-4.0, min(4.0, rate * g / (h + 1.0)))

    def best(members, sums):
        top = None
        for name, v in splits:
            side = [0.0, 0.0, 0.0, 0.0]
            for i in members:
                at = 2 if rows[i][0][name] >= v else 0
                side[at] += sums[i][0]
                side[at + 1] += sums[i][1]
            gain = side[0] ** 2 / (side[1] + 1) + side[2] ** 2 / (side[3] + 1)
            if top is None or gain > top[0] + 1e-12:
                top = (gain, (name, v), side)
        return top

    for _ in range(rounds):
        sums = gradient()
        root = best(range(len(rows)), sums)
        if root is None:
            break
        name, v = root[1]
        tree = [root[1]]
        for high in (False, True):
            members = [i for i, r in enumerate(rows) if (r[0][name] >= v) == high]
            _, split, side = best(members, sums)
            leaves = (leaf(*side[:2]), leaf(*side[2:]))
            tree.append((split, *leaves))
            for i in members:
                scores[i] += leaves[rows[i][0][split[0]] >= split[1]]
        trees.append(tuple(tree))
    return trees


def tree_score(trees, of):
    """Score from a function that gives a feature's value, for numbers and for columns alike."""
    return [(split, low, high) for split, low, high in trees] and sum(
        _branch(of, split, _branch(of, low[0], *low[1:]), _branch(of, high[0], *high[1:]))
        for split, low, high in trees)


def _branch(of, split, below, above):
    value = of(split[0])
    if isinstance(value, int):
        return above if value >= split[1] else below
    wrap = lambda x: x if hasattr(x, "alias") else F.lit(float(x))
    return F.when(value >= split[1], wrap(above)).otherwise(wrap(below))


def train(docs, least_precision=LEAST_PRECISION):
    """(trees, threshold) per kind from all labelled candidates; a kind without a safe threshold has none.

    The threshold is the lowest score from which on the held-back half has the precision asked for.
    """
    halves = _histogram(docs)
    model = {}
    for kind in KINDS:
        sets = [{}, {}]
        for r in halves:
            if r["kind"] == kind:
                key = tuple(r[name] for name in VALUES)
                counts = sets[r["half"]].setdefault(key, [0, 0])
                counts[0 if r["is_base"] else 1] += r["n"]
        fit, check = ([(dict(zip(VALUES, k)), *v) for k, v in sorted(s.items())] for s in sets)
        if not fit or not check:
            continue
        trees = boost(fit)
        ranked = sorted(((tree_score(trees, lambda name, f=f: f[name]), good, bad) for f, good, bad in check),
                        key=lambda x: -x[0])
        good = bad = 0
        threshold = None
        for i, (score, g, b) in enumerate(ranked):
            good, bad = good + g, bad + b
            if i + 1 < len(ranked) and ranked[i + 1][0] == score:
                continue
            if good >= least_precision * (good + bad) and score > 0:
                threshold = score
        if threshold is not None:
            model[kind] = (trees, threshold)
    return model


# --- spans ---------------------------------------------------------------------------------------

def spans(docs, model, carry=()):
    """``doc_id``, ``text``, ``base`` and ``spans`` (arrays of ``s``, ``k``, ``e`` in order, k the kind's number)
    and the counts of base spans per kind."""
    rows = prepared(docs, carry)
    numbered = lambda k: F.transform(F.col(f"base_{k}"), lambda x: F.struct(
        x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))
    base = F.sort_array(F.concat(*[numbered(k) for k in KINDS]))

    def score(x):
        out = F.lit(None).cast("double")
        for kind, (trees, threshold) in model.items():
            s = tree_score(trees, lambda name: x["f"][name])
            out = F.when((x["kind"] == kind) & (s >= threshold - 1e-9), s).otherwise(out)
        return out

    rows = rows.withColumn("base", base).withColumn("picked", F.filter(
        F.transform(F.col("more"), lambda x: F.struct(
            score(x).alias("score"), (x["e"] - x["s"]).alias("n"), (-x["s"]).alias("at"), x["s"].alias("s"),
            F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int").alias("k"), x["e"].alias("e"))),
        lambda x: x["score"].isNotNull()))
    free = F.filter(F.col("picked"), lambda x: ~F.exists(
        F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    rows = rows.withColumn("picked", free)
    added = F.transform(
        F.filter(F.col("picked"), lambda x: ~F.exists(F.col("picked"), lambda y: (
            y["s"] < x["e"]) & (x["s"] < y["e"]) & (
            F.struct(y["score"], y["n"], y["at"], y["k"]) > F.struct(x["score"], x["n"], x["at"], x["k"])))),
        lambda x: F.struct(x["s"].alias("s"), (x["k"] - 1).alias("k"), x["e"].alias("e")))
    columns = [c for c in carry if c not in ("doc_id", "text")]
    return rows.select(
        "doc_id", *columns, "text", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base",
        F.sort_array(F.concat(F.col("base"), added)).alias("spans"))


def written(name):
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(name), lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs, model):
    """``docs`` with every span replaced by its kind in brackets; touching spans become one, named by the first."""
    # The whole row travels in one column, so that no name of it meets one of the operator's.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = spans(docs.select("doc_id", "text", whole.alias("row")), model, carry=["row"])
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] > x["s"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["s"].alias("s"), F.element_at(done, -1)["k"].alias("k"),
                F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(done, F.array(x))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    pieces = let(joined, lambda spans_: F.concat(
        F.array_join(F.transform(spans_, lambda x, i: F.concat(
            let(F.coalesce(F.get(spans_, i - 1)["e"], F.lit(0).cast("bigint")), lambda from_: F.substring(
                text, (from_ + 1).cast("int"), (x["s"] - from_).cast("int"))),
            F.get(tags, x["k"]))), ""),
        F.substring(text, (F.element_at(spans_, -1)["e"] + 1).cast("int"), F.length(text))))
    out = F.when(F.size("spans") > 0, pieces).when(F.col("row.text").isNotNull(), text)
    return rows.select(*[out.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_personal_data(spark, folder):
    """The contract's columns for all of ``documents``."""
    docs = load(spark, folder, "documents")
    return spans(docs, train(docs)).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"))
