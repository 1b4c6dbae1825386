"""Secret scans with DataFrame functions only: fixed patterns and a randomness battery.

Base kinds, leftmost and not overlapping within a kind: ``assign`` (a value of 12 or
more characters given to a name such as password), ``access`` (keys that begin with
AKIA) and ``hex`` (16 or more hexadecimal digits).

The battery looks at all runs of 20 or more characters of the base64 alphabets that
base spans do not cover. A run that they cover in part is tested whole, and so are its
stretches of 20 or more characters outside them, without hyphens at the cut.
A run's encoding is inferred, as the smallest alphabet that holds it (hex; letters of
one case; the base32 alphabets and base36 in either case; letters; base58; base62;
base64), and its characters become values of that alphabet. Chi-squared uniformity, the runs test above and below the middle and
the lag-1 serial correlation each give a p-value under randomness; a run is no secret
if three times the least is below ``ALPHA``. What is left is tested against ordinary
text: its characters coincide more often than random ones do. These p-values go
through Benjamini-Hochberg in each encoding and stratum of lengths, since short runs
carry little evidence: a rank is read off a histogram of fixed size of -ln p, so no
sort of all runs is needed, and p is rounded up to its bucket's edge.

Positions are code points, ends exclusive. Null and empty texts have no spans and the
digest of the empty string. Repeated rows get equal results: nothing is regrouped by
key. An empty table has no thresholds. Other columns are not read by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import materialise

# fixed values: the patterns of the base kinds
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Runs of characters that the battery tests.
LEAST = 20
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Level of the tests against randomness.
ALPHA = 0.001
#: Share of ordinary text among what is found.
FALSE_DISCOVERY = 0.01
#: Coincidence rate of letters in ordinary text.
TEXT_RATE = 0.065
#: Buckets of -ln p, eight for each unit.
BUCKETS = 512
#: Numbers of an array that are summed at once; characters of a piece of a text.
PART, PIECE = 128, 4096
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: In order of size. Those without lower case stand for either case.
ALPHABETS = {
    "hex": DIGITS + "ABCDEF",
    "base26": UPPER,
    "base32": UPPER + "234567",
    "base32hex": DIGITS + UPPER[:22],
    "crockford": DIGITS + "ABCDEFGHJKMNPQRSTVWXYZ",
    "base36": DIGITS + UPPER,
    "base52": UPPER + UPPER.lower(),
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": UPPER + UPPER.lower() + DIGITS,
    "base64": UPPER + UPPER.lower() + DIGITS + "+/",
}
ONE_CASE = tuple(x for x, alphabet in ALPHABETS.items() if alphabet == alphabet.upper())
SPAN = "struct<s:int,k:int,e:int,n:int,v:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def ends_of(lengths: Column) -> Column:
    """Running sums of an array, in time that follows its length.

    Appending to an array copies it, so sums are taken in parts of ``PART`` numbers and
    the parts moved by what stands before them.
    """
    none = F.array().cast("array<int>")

    def sums(numbers: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(
            numbers,
            start,
            lambda state, n: F.struct(
                (state["at"] + n).alias("at"), F.concat(state["out"], F.array(state["at"] + n)).alias("out")
            ),
            lambda state: state["out"],
        )

    def moved(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda x: F.element_at(x, -1)))
        return F.flatten(
            bound(
                before,
                lambda sums_: F.transform(
                    parts, lambda x, i: F.transform(x, lambda n: n + F.coalesce(F.get(sums_, i - 1), F.lit(0)))
                ),
            )
        )

    places = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int"))
    parts = F.transform(places, lambda c: sums(F.slice(lengths, c * PART + 1, F.lit(PART))))
    return F.when(F.size(lengths) > PART, bound(parts, moved)).when(F.size(lengths) > 0, sums(lengths)).otherwise(none)


def spans_of(text: Column, pattern: str, order: int, group: int = 0) -> Column:
    """Matches of a pattern with their places: array of SPAN.

    The text between matches and the matches add up to the places.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # the last gap has no match behind it
    zipped = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        found,
        lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), F.length(m).alias("m")),
    )
    sized = F.zip_with(
        zipped, values, lambda x, v: F.struct(x["step"].alias("step"), x["m"].alias("m"), v.alias("v"))
    )

    def placed(matches: Column) -> Column:
        ends = bound(F.transform(matches, lambda x: x["step"]), ends_of)
        return F.zip_with(
            matches,
            ends,
            lambda x, end: F.struct(
                (end - x["m"]).alias("s"),
                F.lit(order).alias("k"),
                end.alias("e"),
                F.length(x["v"]).alias("n"),
                x["v"].alias("v"),
            ),
        )

    none = F.array().cast(f"array<{SPAN}>")
    # most texts have no match: the places are only worked out where one exists
    return F.when(text.rlike(pattern), bound(sized, placed)).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation of Abramowitz and Stegun (26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # fixed values: the coefficients of that formula
    poly = t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(run: Column) -> Column:
    """The smallest alphabet that holds a run; plain numbers have none."""
    found = F.when(run.rlike("^[0-9]+$"), F.lit(None).cast("string"))
    for name, alphabet in ALPHABETS.items():
        cases = (alphabet, alphabet.lower()) if name in ONE_CASE else (alphabet,)
        if name != "base64":
            found = found.when(run.rlike("^(?:" + "|".join(f"[{x}]+" for x in cases) + ")$"), name)
    return found.otherwise("base64")


def with_fields(rows: Column, keep: tuple[str, ...], **fields) -> Column:
    """Structs with some of their fields and new ones made from each.

    A step's values are fields of the next step's variable, so no expression is
    written out (or evaluated) more than once.
    """
    return F.transform(
        rows,
        lambda r: F.struct(*(r[k].alias(k) for k in keep), *(f(r).alias(k) for k, f in fields.items())),
    )


def tested(runs: Column) -> Column:
    """Runs as struct(s, e, n, kind, random: p under randomness, text: p under ordinary text)."""
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    rows = with_fields(runs, ("s", "e", "v"), kind=lambda r: encoding(r["v"]))
    rows = with_fields(
        F.filter(rows, lambda r: r["kind"].isNotNull()),
        ("s", "e", "kind"),
        plain=lambda r: F.when(r["kind"].isin(*ONE_CASE), F.upper(r["v"])).otherwise(F.translate(r["v"], "-_", "+/")),
        alphabet=lambda r: alphabets[r["kind"]],
    )
    place = ("s", "e", "kind")
    rows = with_fields(
        rows,
        (*place, "plain", "alphabet"),
        n=lambda r: F.length(r["plain"]).cast("double"),
        k=lambda r: F.length(r["alphabet"]).cast("double"),
        chars=lambda r: F.split(r["plain"], ""),
    )
    rows = with_fields(
        rows,
        (*place, "n", "k"),
        squares=lambda r: F.aggregate(
            F.transform(
                F.array_distinct(r["chars"]), lambda c: r["n"] - F.length(F.replace(r["plain"], c))
            ),
            F.lit(0.0),
            lambda a, c: a + c * c,
        ),
        values=lambda r: F.transform(r["chars"], lambda c: F.instr(r["alphabet"], c).cast("double")),
    )
    rows = with_fields(
        rows,
        (*place, "n", "k", "squares", "values"),
        # above and below the middle of the alphabet
        sides=lambda r: F.array_join(
            F.transform(r["values"], lambda v: F.when(v * 2 > r["k"], "H").otherwise("L")), ""
        ),
        mean=lambda r: F.aggregate(r["values"], F.lit(0.0), lambda a, v: a + v) / r["n"],
    )
    rows = with_fields(
        rows,
        (*place, "n", "k", "squares"),
        high=lambda r: r["n"] - F.length(F.replace(r["sides"], F.lit("H"))),
        changes=lambda r: F.length(F.regexp_replace(r["sides"], r"(.)\1*", "$1")).cast("double"),
        centred=lambda r: F.transform(r["values"], lambda v: v - r["mean"]),
    )
    rows = with_fields(
        rows,
        (*place, "n", "k", "squares", "changes"),
        expected=lambda r: 2 * r["high"] * (r["n"] - r["high"]) / r["n"] + 1,
        power=lambda r: F.greatest(
            F.aggregate(r["centred"], F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-9)
        ),
        lagged=lambda r: F.aggregate(
            F.zip_with(
                F.slice(r["centred"], F.lit(1), F.size(r["centred"]) - 1),
                F.slice(r["centred"], F.lit(2), F.size(r["centred"]) - 1),
                lambda a, b: a * b,
            ),
            F.lit(0.0),
            lambda a, v: a + v,
        ),
        # coincidences among all pairs of characters, fewer than in text
        pairs=lambda r: r["n"] * (r["n"] - 1) / 2,
        rate=lambda r: F.greatest(F.lit(TEXT_RATE), 2 / r["k"]),
        # the cube root makes chi-squared normal (Wilson and Hilferty)
        free=lambda r: 2 / (9 * (r["k"] - 1)),
    )
    rows = with_fields(
        rows,
        (*place, "n"),
        chi=lambda r: (
            F.pow((r["squares"] * r["k"] / r["n"] - r["n"]) / (r["k"] - 1), F.lit(1 / 3)) - (1 - r["free"])
        )
        / F.sqrt(r["free"]),
        runs=lambda r: F.abs(r["changes"] - r["expected"])
        / F.sqrt(F.greatest((r["expected"] - 1) * (r["expected"] - 2) / (r["n"] - 1), F.lit(1e-9))),
        serial=lambda r: F.abs(r["lagged"] / r["power"]) * F.sqrt(r["n"]),
        together=lambda r: (r["pairs"] * r["rate"] - (r["squares"] - r["n"]) / 2)
        / F.sqrt(r["pairs"] * r["rate"] * (1 - r["rate"])),
    )
    return with_fields(
        rows,
        (*place, "n"),
        random=lambda r: F.least(
            3 * F.least(normal_tail(r["chi"]), 2 * normal_tail(r["runs"]), 2 * normal_tail(r["serial"])),
            F.lit(1.0),
        ),
        text=lambda r: normal_tail(r["together"]),
    )


def uncovered(runs: Column, base: Column) -> Column:
    """Runs, and stretches of them, that base spans leave free: array of struct(s, e, v)."""

    def add(state: Column, b: Column) -> Column:
        gap = F.struct(state["at"].alias("s"), b["s"].alias("e"))
        gaps = F.when(b["s"] > state["at"], F.concat(state["gaps"], F.array(gap))).otherwise(state["gaps"])
        return F.struct(F.greatest(state["at"], b["e"]).alias("at"), gaps.alias("gaps"))

    def cut(r: Column, near: Column) -> Column:
        # base spans are sorted by their start; an empty one stands at the run's end
        last = F.array(F.struct(r["e"].alias("s"), r["e"].alias("e")))
        start = F.struct(r["s"].alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("gaps"))
        return F.aggregate(F.concat(near, last), start, add, lambda x: x["gaps"])

    def stretches(r: Column, gaps: Column) -> Column:
        parts = F.transform(
            gaps, lambda g: F.struct(g.alias("g"), F.substring(r["v"], g["s"] - r["s"] + 1, g["e"] - g["s"]).alias("v"))
        )
        # separators next to a base span are no part of a token
        parts = with_fields(
            parts, ("g",), v=lambda x: F.when(x["g"]["s"] > r["s"], F.ltrim(x["v"], F.lit("-_"))).otherwise(x["v"])
        )
        parts = with_fields(
            parts,
            (),
            s=lambda x: x["g"]["e"] - F.length(x["v"]),
            v=lambda x: F.when(x["g"]["e"] < r["e"], F.rtrim(x["v"], F.lit("-_"))).otherwise(x["v"]),
        )
        parts = with_fields(parts, ("s",), e=lambda x: x["s"] + F.length(x["v"]), v=lambda x: x["v"])
        return F.filter(parts, lambda x: x["e"] - x["s"] >= LEAST)

    rows = with_fields(
        with_fields(runs, ("s", "e", "v")),
        (),
        run=lambda r: r,
        near=lambda r: F.filter(base, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])),
    )
    rows = with_fields(
        rows,
        ("run", "near"),
        gaps=lambda x: F.when(
            F.size(x["near"]) > 0,
            cut(x["run"], F.transform(x["near"], lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))),
        ),
    )
    tests = F.transform(
        rows,
        lambda x: F.when(x["gaps"].isNull(), F.array(x["run"]))
        .when(F.size(x["gaps"]) > 0, F.concat(F.array(x["run"]), stretches(x["run"], x["gaps"])))
        .otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>")),
    )
    return F.flatten(tests)


def candidates(runs: Column, base: Column) -> Column:
    """Runs not covered by base spans that randomness is not rejected for, with bucket and stratum."""
    return F.transform(
        F.filter(tested(uncovered(runs, base)), lambda c: c["random"] >= ALPHA),
        lambda c: F.struct(
            c["s"].alias("s"),
            c["e"].alias("e"),
            # strata of lengths: halves of powers of two
            F.concat_ws("/", c["kind"], F.floor(F.log2(c["n"]) * 2).cast("string")).alias("stratum"),
            F.least(
                F.lit(BUCKETS - 1), F.floor(-8 * F.log(F.greatest(c["text"], F.lit(1e-300))))
            )
            .cast("int")
            .alias("bucket"),
        ),
    )


def thresholds(found: DataFrame, rate: float) -> dict[str, int]:
    """Benjamini-Hochberg by stratum: the least bucket that is a discovery.

    ``found`` has a candidate per row (stratum, bucket). The result has a row for each
    encoding and length stratum.
    """
    counts = found.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.desc("bucket"))
    every = Window.partitionBy("stratum")
    ranked = counts.select(
        "stratum", "bucket", F.sum("n").over(above).alias("rank"), F.sum("n").over(every).alias("m")
    )
    passing = ranked.where(F.exp(-F.col("bucket") / 8) * F.col("m") <= F.lit(rate) * F.col("rank"))
    return {r[0]: r[1] for r in passing.groupBy("stratum").agg(F.min("bucket")).collect()}


def scan(
    docs: DataFrame, rate: float = FALSE_DISCOVERY, columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """row (a struct of the named columns), base (base spans) and spans (all spans).

    Spans are sorted arrays of struct(s, k, e): start, kind's number (assign 0, access 1,
    hex 2, random 3), end.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*columns).alias("row"), text.alias("text"))
    read = rows.select(
        "row",
        F.filter(spans_of(F.col("text"), ASSIGN, 0, 1), lambda x: x["n"] >= 12).alias("assign"),
        spans_of(F.col("text"), ACCESS, 1).alias("access"),
        spans_of(F.col("text"), HEX, 2).alias("hexes"),
        spans_of(F.col("text"), RUN, 3).alias("runs"),
    )
    base = F.array_sort(F.concat("assign", "access", "hexes"))
    # written once: texts are not scanned again
    placed = materialise(
        read.select("row", base.alias("base"), "runs").select(
            "row",
            F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias(
                "base"
            ),
            candidates(F.col("runs"), F.col("base")).alias("found"),
        )
    )
    found = placed.select(F.explode("found").alias("f")).select("f.stratum", "f.bucket")
    least = thresholds(found, rate)
    if least:
        table = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        more = F.transform(
            F.filter("found", lambda c: c["bucket"] >= F.coalesce(table[c["stratum"]], F.lit(BUCKETS))),
            lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")),
        )
    else:
        more = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return placed.select("row", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def without_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """All rows and columns, with secrets replaced in the text and its length counted anew."""
    found = scan(docs, rate, tuple(docs.columns))
    text = redacted(F.coalesce("row.text", F.lit("")), F.col("spans"))
    changed = F.size("spans") > 0
    out = []
    for name in docs.columns:
        old = F.col("row")[name]
        new = {"text": text, "n_chars": F.length(text).cast(docs.schema[name].dataType)}.get(name)
        out.append((old if new is None else F.when(changed, new).otherwise(old)).alias(name))
    return found.select(*out)


NAMES = ("assign", "access", "hex", "random")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(x) for x in NAMES])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(
                ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")
            ),
        ),
        ",",
    )


def counted(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == order)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by a mark.

    Spans are sorted by their start. The text is cut into pieces of fixed size once and what
    stays is taken from them, so a place deep in a long text costs no more than another.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(cut: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        head = F.coalesce(F.get(cut, first), F.lit(""))
        tail = F.coalesce(F.get(cut, last), F.lit(""))
        whole = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(head, start % PIECE + 1, end - start)).otherwise(
            F.concat(F.substring(head, start % PIECE + 1, F.lit(PIECE)), whole, F.substring(tail, F.lit(1), end % PIECE))
        )

    def merged(reach: Column) -> Column:
        """Stretches that stay: from the furthest end so far to a span that begins behind it."""
        rows = F.zip_with(
            reach,
            F.slice(F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text))), F.lit(2), F.size(spans)),
            lambda at, s: F.struct(at.alias("from"), s.alias("to")),
        )
        # touching spans are two marks, overlapping ones are one
        return F.filter(rows, lambda r: r["to"] >= r["from"])

    def rebuilt(cut: Column) -> Column:
        first = between(cut, F.lit(0), F.get(spans, 0)["s"])
        rest = F.transform(merged(bound(F.transform(spans, lambda x: x["e"]), furthest)), lambda r: between(cut, r["from"], r["to"]))
        return F.concat(first, F.lit(mark), F.array_join(rest, mark))

    return F.when(F.size(spans) > 0, bound(pieces, rebuilt)).otherwise(text)


def furthest(ends: Column) -> Column:
    """The largest number so far at every place of an array, in parts like ``ends_of``."""
    none = F.array().cast("array<int>")

    def tops(numbers: Column, start: Column) -> Column:
        return F.aggregate(
            numbers,
            F.struct(start.alias("at"), none.alias("out")),
            lambda state, n: F.struct(
                F.greatest(state["at"], n).alias("at"),
                F.concat(state["out"], F.array(F.greatest(state["at"], n))).alias("out"),
            ),
            lambda state: state["out"],
        )

    def moved(parts: Column) -> Column:
        before = tops(F.transform(parts, lambda x: F.element_at(x, -1)), F.lit(0))
        return F.flatten(
            bound(
                before,
                lambda tops_: F.transform(
                    parts,
                    lambda x, i: F.transform(x, lambda n: F.greatest(n, F.coalesce(F.get(tops_, i - 1), F.lit(0)))),
                ),
            )
        )

    places = F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / PART).cast("int"))
    parts = F.transform(places, lambda c: tops(F.slice(ends, c * PART + 1, F.lit(PART)), F.lit(0)))
    return F.when(F.size(ends) > PART, bound(parts, moved)).otherwise(tops(ends, F.lit(0)))
