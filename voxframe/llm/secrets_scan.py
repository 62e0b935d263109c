"""Secret scan with DataFrame functions only (operator 7).

Base spans come from three fixed patterns. The method adds spans: tokens of at least
``LEAST_TOKEN`` characters whose encoding can be inferred (upper-case hex, base32, base36, base62,
base64; all need a digit) go through a randomness battery: chi-squared uniformity over the
encoding's alphabet, a runs test and a lag-1 serial-correlation test on the symbols' places. A token
is kept if the battery doesn't reject uniformity and it is unlike written text: written letters have
the frequencies of prose (a normal test of their mean log-frequency), and digits come in runs (a
binomial test of the changes between letter and digit). Hex has only the latter, as six letters show
no prose; the others have both, combined by Fisher's rule. These p-values are held against a
false-discovery rate (Benjamini-Hochberg) within each class of length, over the whole corpus, since
a short token can show little. Only a count for each class and step of p reaches the driver.

Rows: a null text counts as empty; ties (equal starts) are ordered as the kinds are listed; a
repeated row is scanned alike; an empty table gives an empty result. Starts and ends are code
points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, id_and_text, prepare, stored

#: The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # maximal runs, so the same spans as AKIA[A-Z0-9]+ of 18 or more
HEX = r"[0-9a-f]{16,}"  # likewise for [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "random")
LEAST_TOKEN = 12
TOKEN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+"  # with a digit
#: Symbols of the encodings in their order; url-safe base64 has its last two under other names.
ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Letters of written text a to z, per thousand; the share of places where written tokens change between letter and digit; the two error rates.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
CHANGES, UNIFORM_LEVEL, FALSE_DISCOVERY = 0.15, 0.001, 0.001
LONG_TOKEN = 1000  # from here on, a bound on the binomial tail
STRETCH, PIECE = 256, 4096  # matches whose offsets are summed together; code points of a piece of text
P_STEPS = 400  # of a tenth of a decimal digit

SPANS = "array<struct<start:int,kind:int,end:int>>"


def normal_cdf(z: Column) -> Column:
    """Logistic approximation of the normal distribution function, within 0.00015."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, kind: int, values: Callable[[], Column] | None = None, more: Callable[[Column, Column], Column] | None = None) -> Column:
    """Spans of all matches, leftmost first. values: of each match, the part that must have ``LEAST_VALUE`` characters.

    more(span, match): what to make of each span. The offsets are summed within stretches of
    ``STRETCH`` matches and over the stretches, so that the cost doesn't grow with the square of the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    stays = F.transform(values(), lambda v: F.length(v) >= LEAST_VALUE) if values else F.transform(found, lambda _: F.lit(True))
    steps = F.zip_with(F.arrays_zip(found.alias("match"), stays.alias("stays")), F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(gap.alias("gap"), F.length(m["match"]).alias("size"), m["stays"].alias("stays"), m["match"].alias("match")))

    def spread(steps: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int")), lambda i: F.slice(steps, i * STRETCH + 1, F.lit(STRETCH)))

        def offsets(stretches: Column) -> Column:
            sums = F.transform(stretches, lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + x["gap"] + x["size"]))
            return F.aggregate(sums, F.array(F.lit(0)), lambda so_far, x: F.concat(so_far, F.array(F.element_at(so_far, -1) + x)))

        def inside(part: Column, begin: Column) -> Column:
            ends = F.aggregate(part, F.array(begin), lambda so_far, x: F.concat(so_far, F.array(F.element_at(so_far, -1) + x["gap"] + x["size"])))
            return F.zip_with(part, F.slice(ends, F.lit(1), F.size(part)), lambda x, at: F.struct(F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end")).alias("span"), x["stays"].alias("stays"), x["match"].alias("match")))

        return let(stretches, lambda parts: F.flatten(F.zip_with(parts, F.slice(offsets(parts), F.lit(1), F.size(parts)), inside)))

    kept = F.filter(let(steps, spread), lambda x: x["stays"])
    result = F.transform(kept, lambda x: more(x["span"], x["match"]) if more else x["span"])
    return F.when(text.rlike(pattern), result).otherwise(F.array() if more else F.array().cast(SPANS))


def unlike_text(token: Column, encoding: Column) -> Column:
    """p-value of a token of the encoding under the rates of written text; low for random tokens."""
    total = sum(LETTERS)
    weights = [math.log(26 * x / total) for x in LETTERS]
    mean = sum(x * w for x, w in zip(LETTERS, weights)) / total
    spread = math.sqrt(sum(x * w * w for x, w in zip(LETTERS, weights)) / total - mean * mean)
    low = F.lower(token)
    # Of each letter, how often it is found: as many passes as there are letters, each at the speed of a search.
    counts = [(F.length(token) - F.length(F.replace(low, F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(26)]
    letters = F.struct(sum(counts[1:], counts[0]).alias("n"), sum((c * w for c, w in zip(counts, weights)), F.lit(0.0)).alias("score"))
    changes = F.regexp_count(token, F.lit(r"(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]")).cast("double")

    def p_letters(x: Column) -> Column:
        n = F.greatest(x["n"], F.lit(1.0))  # a token without letters has no encoding, but may be computed
        return normal_cdf((x["score"] - n * mean) / (spread * F.sqrt(n)))

    def p_changes(x: Column) -> Column:
        trials, k, odds = x["trials"], x["changes"], CHANGES / (1 - CHANGES)
        start = F.struct(F.pow(F.lit(1 - CHANGES), trials).alias("mass"), F.when(k <= 0, F.pow(F.lit(1 - CHANGES), trials)).otherwise(0.0).alias("tail"))

        def add(so_far: Column, i: Column) -> Column:
            return let(so_far["mass"] * (trials - i + 1) / i * odds, lambda mass: F.struct(mass.alias("mass"), (so_far["tail"] + F.when(i >= k, mass).otherwise(0.0)).alias("tail")))

        tail = F.aggregate(F.sequence(F.lit(1), F.least(trials, F.lit(LONG_TOKEN)).cast("int")), start, add, lambda s: s["tail"])
        rate = F.least(F.greatest(k / trials, F.lit(CHANGES)), F.lit(0.999999))
        bound = F.exp(-trials * (rate * F.log(rate / CHANGES) + (1 - rate) * F.log((1 - rate) / (1 - CHANGES))))
        return F.when(trials >= LONG_TOKEN, bound).otherwise(F.least(tail, F.lit(1.0)))

    both = F.struct(let(letters, p_letters).alias("letters"), let(F.struct((F.length(token) - 1).cast("double").alias("trials"), changes.alias("changes")), p_changes).alias("changes"))
    fisher = lambda x: let(F.greatest(x["letters"] * x["changes"], F.lit(1e-300)), lambda p: p * (1 - F.log(p)))
    return let(both, lambda x: F.when(encoding == "hex", x["changes"]).otherwise(fisher(x)))


def battery(token: Column) -> Column:
    """struct(encoding, n, p_uniform, p_text) of a token; encoding is null where none can be inferred.

    One pass over the symbols' places gives all sums that the tests need, so the cost grows with the token's length.
    """
    encoding = (
        F.when(token.rlike(r"^[0-9A-F]+$") & token.rlike(r"[0-9]") & token.rlike(r"[A-F]"), "hex")
        .when(token.rlike(r"^[A-Z2-7]+$") & token.rlike(r"[2-7]"), "base32")
        .when(token.rlike(r"^([0-9A-Z]+|[0-9a-z]+)$") & token.rlike(r"[0-9]") & token.rlike(r"[A-Za-z]"), "base36")
        .when(token.rlike(r"[A-Z]") & token.rlike(r"[a-z]") & token.rlike(r"[0-9]"), F.when(token.rlike(r"[+/_-]"), "base64").otherwise("base62"))
    )
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])

    def symbols(x: Column) -> Column:
        written = F.when(x["encoding"] == "base36", F.upper(x["token"])).otherwise(F.translate(x["token"], "-_", "+/"))
        return F.struct(written.alias("written"), alphabets[x["encoding"]].alias("alphabet"), x["token"].alias("token"), x["encoding"].alias("encoding"))

    def sums(x: Column) -> Column:
        size = F.length(x["alphabet"]).cast("double")
        places = F.transform(F.filter(F.split(x["written"], ""), lambda c: c != ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "s1", "s2", "next", "above", "changes")], F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"))

        def add(a: Column, p: Column) -> Column:
            over, before = p >= size / 2, a["last"] >= size / 2
            return F.struct(
                (a["n"] + 1).alias("n"), (a["s1"] + p).alias("s1"), (a["s2"] + p * p).alias("s2"), (a["next"] + F.coalesce(a["last"] * p, F.lit(0.0))).alias("next"),
                (a["above"] + F.when(over, 1.0).otherwise(0.0)).alias("above"), (a["changes"] + F.when(F.coalesce(over != before, F.lit(False)), 1.0).otherwise(0.0)).alias("changes"),
                F.coalesce(a["first"], p).alias("first"), p.alias("last"),
            )

        squares = F.aggregate(F.filter(F.split(x["alphabet"], ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.pow((F.length(x["written"]) - F.length(F.replace(x["written"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.struct(F.aggregate(places, zero, add).alias("a"), squares.alias("squares"), size.alias("size"), x["token"].alias("token"), x["encoding"].alias("encoding"))

    def tests(x: Column) -> Column:
        a, size, n = x["a"], x["size"], x["a"]["n"]
        chi, free = x["squares"] * size / n - n, size - 1
        z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        mixed = a["above"] * (n - a["above"])
        spread = 2 * mixed * (2 * mixed - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (a["changes"] - 2 * mixed / n) / F.sqrt(spread)).otherwise(99.0)
        mean = a["s1"] / n
        var = a["s2"] - n * mean * mean
        both = a["next"] - mean * (2 * a["s1"] - a["first"] - a["last"]) + (n - 1) * mean * mean
        z_serial = F.when(var > 0, both / var * F.sqrt(n)).otherwise(99.0)
        p_uniform = F.least(F.lit(1.0), 3 * F.least(1 - normal_cdf(z_chi), 2 * (1 - normal_cdf(F.abs(z_runs))), 2 * (1 - normal_cdf(F.abs(z_serial)))))
        return F.struct(n.cast("int").alias("n"), p_uniform.alias("p_uniform"), unlike_text(x["token"], x["encoding"]).alias("p_text"))

    known = F.struct(token.alias("token"), encoding.alias("encoding"))
    return let(known, lambda x: F.when(x["encoding"].isNotNull(), let(let(symbols(x), sums), tests)))


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans in order, and the tokens that an encoding fits, with the battery's p-values."""
    assign = located(text, ASSIGN, 0, values=lambda: F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    access = F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, 1)).otherwise(F.array().cast(SPANS))
    base = F.array_sort(F.concat(assign, access, located(text, HEX, 2)))
    tested = located(text, TOKEN, 3, more=lambda span, token: F.struct(span.alias("span"), battery(token).alias("p")))
    return base, F.filter(tested, lambda t: t["p"].isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base, tokens of every whole text."""
    base, tokens = candidates(F.coalesce("text", F.lit("")))
    return id_and_text(docs).select("doc_id", base.alias("base"), tokens.alias("tokens"))


def all_spans(base: Column, tokens: Column, allowed: dict[int, float]) -> Column:
    """The base spans and those tokens that the battery and the false-discovery control keep, in order."""
    limit = F.create_map(*[F.lit(x) for kv in sorted(allowed.items()) for x in kv]) if allowed else F.create_map().cast("map<int,double>")
    random = F.filter(tokens, lambda t: (t["p"]["p_uniform"] >= UNIFORM_LEVEL) & (t["p"]["p_text"] <= F.coalesce(limit[F.floor(F.log2(t["p"]["n"])).cast("int")], F.lit(-1.0))))
    return F.array_sort(F.concat(base, F.transform(random, lambda t: t["span"])))


def thresholds(tokens: DataFrame) -> dict[int, float]:
    """For each class of length (floor(log2 n)), the greatest p_text that the false-discovery rate allows."""
    step = F.least(F.lit(P_STEPS), F.floor(-10 * F.log10(F.greatest("p.p_text", F.lit(1e-45)))).cast("int"))
    rows = tokens.groupBy(F.floor(F.log2("p.n")).cast("int").alias("c"), step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()
    found = {}
    for c in {r["c"] for r in rows}:
        own = sorted((r["step"], r["k"]) for r in rows if r["c"] == c)
        total, below = sum(k for _, k in own), 0
        for s, k in reversed(own):  # from the least p upwards
            below += k
            if math.pow(10, -s / 10) <= FALSE_DISCOVERY * below / total:
                found[c] = math.pow(10, -s / 10)
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of struct(start, kind, end), kind an index into KINDS."""
    rows = cut(scanned(docs))
    allowed = thresholds(rows.select(F.explode("tokens").alias("t")).select("t.p"))
    return rows.select("doc_id", "base", all_spans(F.col("base"), F.col("tokens"), allowed).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mask.

    spans: in order. What stays is cut from pieces of ``PIECE`` code points and the spans are folded in
    stretches, so that neither a long text nor many spans cost their square.
    """
    gaps_type = "array<struct<from:int,to:int>>"

    def step(so_far: Column, s: Column) -> Column:
        gap = F.struct(so_far["at"].alias("from"), s["start"].alias("to"))
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.when(s["start"] >= so_far["at"], F.concat(so_far["gaps"], F.array(gap))).otherwise(so_far["gaps"]).alias("gaps"))

    def stretch(so_far: Column, part: Column) -> Column:
        start = F.struct(so_far["at"].alias("at"), F.array().cast(gaps_type).alias("gaps"))
        return let(F.aggregate(part, start, step), lambda own: F.struct(own["at"].alias("at"), F.concat(so_far["gaps"], own["gaps"]).alias("gaps")))

    def cut_out(x: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first, size = F.floor(begin / PIECE).cast("int"), end - begin
            joined = F.array_join(F.slice(x["pieces"], first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(size > 0, F.substring(joined, begin % PIECE + 1, size)).otherwise("")

        start = F.struct(F.lit(0).alias("at"), F.array().cast(gaps_type).alias("gaps"))
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["spans"]) - 1) / STRETCH).cast("int")), lambda i: F.slice(x["spans"], i * STRETCH + 1, F.lit(STRETCH)))
        return let(F.aggregate(stretches, start, stretch), lambda s: F.concat(F.array_join(F.transform(s["gaps"], lambda g: piece(g["from"], g["to"])), mask), F.lit(mask), piece(s["at"], x["size"])))

    known = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans"), F.length(text).alias("size"))
    return F.when(F.size(spans) == 0, text).otherwise(let(known, cut_out))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span masked in text; n_chars follows the text, other columns stay.

    Texts are scanned once; the spans found wait in the checkpoint folder, beside their rows, for the false-discovery limits.
    """
    base, tokens = candidates(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    found = stored(docs.select(F.struct("*").alias("row")).select("row", base.alias("base"), tokens.alias("tokens")))
    allowed = thresholds(found.select(F.explode("tokens").alias("t")).select("t.p"))
    spans = found.select("row", all_spans(F.col("base"), F.col("tokens"), allowed).alias("spans"))
    clean = spans.select("row", masked(F.col("row.text"), F.col("spans")).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
