"""Secret scans: fixed patterns, and a randomness test battery, with DataFrame functions only.

Patterns give the base spans. Beside them, every run of 20 or more token characters that has a letter and a digit is a
candidate. A run that no encoding fits, such as NAME=value or path/token_x, is cut at its equals signs, and a part that
still fits none gives its longest pieces that do, and those between any symbols (they may overlap). A candidate's
encoding is inferred from its characters (hex, base 32, lower-case or upper-case alphanumeric, base 64); its symbols, as
places in that alphabet, are tested for being random:

* chi-squared uniformity over the alphabet (Wilson-Hilferty),
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* serial correlation at lag 1.

A candidate that the battery rejects (smallest of the three p-values, times three, below ALPHA) is not random. Passing
is no evidence by itself, as short tokens pass for want of power. So the rest are tested against the opposite null
hypothesis, that they are written by people: runs of one kind of character (a capital leads a run of small letters) are
at least 1 / RUN_RATE long on average, and letters coincide as they do in English. The p-values of that test go through
a weighted Benjamini-Hochberg step over all candidates of the corpus; weights are proportional to length, as long
candidates can be told apart with more power, and have mean 1. So among the spans that are added, the expected share of
written ones is at most LEVEL. Discoveries that don't overlap a base span are added. The step needs only counts of
p-values on a fixed grid, so nothing is sorted over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.workspace import Workspace

# fixed values: the patterns of the base kinds, and the least characters of a match (of group 2 for the first)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: Characters of a candidate, at least.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: What an encoding fits; parts of a run that none fits, and pieces of a part that none fits. The last keep their padding.
FITS = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
PART = r"[A-Za-z0-9+/_-]{20,}(?:=+$)?"
PIECES = (r"[A-Za-z0-9+/]{20,}(?:=+$)?", r"[A-Za-z0-9_-]{20,}(?:=+$)?", r"[A-Za-z0-9]{20,}(?:=+$)?")
# fixed values: alphabets of the encodings, in the order in which they are tried
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Share of written tokens among the added ones that is tolerated; p-values are counted at 10 ** (-k / GRID).
LEVEL, GRID, DECADES = 0.05, 8, 40
#: The battery rejects below this.
ALPHA = 0.01
#: Runs of one kind of character in written tokens, per character, at most.
RUN_RATE = 0.25
RUN = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
# fixed values: sums of the squares and of the cubes of the shares of letters in English, and the share of A to F
SQUARES, CUBES, HEX_LETTERS = 0.0655, 0.00535, 0.316
#: Matches whose starts are summed at once; the blocks of so many are summed after that.
BLOCK = 512


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, found, part>> of the leftmost matches, in code points; part is the group, if given.

    Matches and the gaps between them alternate, so starts are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), part.alias("part"))
    none = F.array().cast("array<struct<start:int,end:int,found:string,part:string>>")

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["found"])
        own = F.struct(begin.alias("start"), end.alias("end"), piece["found"].alias("found"), piece["part"].alias("part"))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(piece["found"].isNull(), state["out"]).otherwise(F.array_append(state["out"], own)).alias("out"))

    def block(own: Column) -> Column:
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def chain(state: Column, own: Column) -> Column:
        begin = state["at"]
        moved = F.transform(own["out"], lambda m: F.struct((m["start"] + begin).alias("start"), (m["end"] + begin).alias("end"), m["found"].alias("found"), m["part"].alias("part")))
        return F.struct((begin + own["at"]).alias("at"), F.array_append(state["out"], moved).alias("out"))

    # appending copies an array, so blocks of matches are summed each by itself, and then the blocks
    of_blocks = F.transform(F.array(pieces), lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda k: block(F.slice(all_, k + 1, F.lit(BLOCK)))))[0]
    blocks = F.aggregate(of_blocks, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), chain, lambda s: F.flatten(s["out"]))
    return F.when(text.rlike(pattern), blocks).otherwise(none)


def candidates(text: Column) -> Column:
    """array<struct<start, end, found>> of the runs of token characters, or of what of them an encoding fits."""

    def own(m: Column, at: Column | int = 0) -> Column:
        return F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["found"].alias("found"))

    def pieces(part: Column) -> Column:
        found = F.concat(*(matches(part["found"], p) for p in PIECES))
        return F.array_distinct(F.transform(found, lambda m: own(m, part["start"])))

    def parts(run: Column) -> Column:
        cut = F.transform(matches(run["found"], PART), lambda m: own(m, run["start"]))
        return F.flatten(F.transform(cut, lambda m: F.when(m["found"].rlike(FITS), F.array(own(m))).otherwise(pieces(m))))

    runs = matches(text, TOKEN)
    return F.flatten(F.transform(runs, lambda m: F.when(m["found"].rlike(FITS), F.array(own(m))).otherwise(parts(m))))


def upper_tail(z: Column) -> Column:
    """P(normal > z), within a few hundredths of its value even far out (Karagiannidis and Lioumpas)."""
    a = F.greatest(F.abs(z), F.lit(1e-9))
    q = (1 - F.exp(-1.4 * a)) * F.exp(-F.least(a * a / 2, F.lit(600.0))) / (1.135 * (2 * 3.141592653589793) ** 0.5 * a)
    return F.when(z >= 0, q).otherwise(1 - q)


def chi_squared_tail(x: Column, freedom: Column) -> Column:
    part = F.lit(2.0) / (9 * freedom)
    return upper_tail((F.pow(x / freedom, F.lit(1.0 / 3)) - (1 - part)) / F.sqrt(part))


def randomness(token: Column) -> Column:
    """The p-value of a token's randomness; null if no encoding fits or it lacks a letter or a digit."""
    body = F.rtrim(token, F.lit("="))
    alphabet = F.lit(None).cast("string")
    for _, pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(body.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    fit = F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]") & (F.length(body) >= 20), alphabet)
    symbols = F.when(fit.isNotNull(), F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(fit, c) - 1))
    # each transform of one element binds a value, so that no inner function computes it again for every symbol
    bound = F.transform(F.array(F.struct(fit.alias("letters"), symbols.alias("x"))), _with_mean)
    return F.transform(bound, _battery)[0]


def written(token: Column) -> Column:
    """The p-value of a token's being written by people: runs and coincidences of letters, or hex digits alone."""
    n = F.length(token).cast("double")
    runs = (F.regexp_count(token, F.lit(RUN)) - 1 - RUN_RATE * (n - 1)) / F.sqrt(RUN_RATE * (1 - RUN_RATE) * (n - 1))
    folded = F.lower(token)
    letters = F.regexp_count(folded, F.lit("[a-z]")).cast("double")
    count = lambda c: (F.length(folded) - F.length(F.replace(folded, c, F.lit("")))).cast("double")
    alphabet = F.array(*(F.lit(chr(c)) for c in range(97, 123)))
    equal = F.aggregate(alphabet, F.lit(0.0), lambda s, c: s + count(c) * (count(c) - 1))
    pairs = letters * (letters - 1)
    spread = 4 * pairs * (letters - 2) * CUBES + 2 * pairs * SQUARES - pairs * (4 * letters - 6) * SQUARES**2
    unequal = F.when(spread > 0, (pairs * SQUARES - equal) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(0.0)
    hexes = F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.pow(F.lit(HEX_LETTERS), letters)).otherwise(1.0)
    return F.least(2 * F.least(upper_tail((runs + unequal) / 2**0.5), hexes), F.lit(1.0))


def _with_mean(t: Column) -> Column:
    return F.struct(t["letters"].alias("letters"), t["x"].alias("x"), (F.aggregate(t["x"], F.lit(0.0), lambda s, v: s + v) / F.size(t["x"])).alias("mean"))


def _battery(t: Column) -> Column:
    x, k = t["x"], F.length(t["letters"]).cast("double")
    n = F.size(x).cast("double")
    zero = F.lit(0.0)
    squares = F.aggregate(F.sequence(F.lit(0), F.length(t["letters"]) - 1), zero, lambda s, c: s + F.pow(F.size(F.filter(x, lambda v: v == c)).cast("double"), F.lit(2.0)))
    p_chi = chi_squared_tail(F.greatest(squares * k / n - n, zero), k - 1)
    high = F.aggregate(x, zero, lambda s, v: s + F.when(v >= k / 2, 1.0).otherwise(0.0))
    later = F.slice(x, F.lit(2), F.size(x) - 1)
    pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), later.alias("b"))
    changes = F.aggregate(pairs, zero, lambda s, p: s + F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0))
    mid = 2 * high * (n - high) / n + 1
    spread = (mid - 1) * (mid - 2) / (n - 1)
    p_runs = F.when(spread > 0, 2 * upper_tail(F.abs(changes + 1 - mid) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(zero)
    mean = t["mean"]
    around = F.aggregate(x, zero, lambda s, v: s + (v - mean) * (v - mean))
    product = F.aggregate(pairs, zero, lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
    p_serial = F.when(around > 0, 2 * upper_tail(F.abs(product / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(zero)
    return F.when(t["letters"].isNotNull(), F.least(3 * F.least(p_chi, p_runs, p_serial), F.lit(1.0)))


def _kind(found: Column, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """Spans of likely secrets in every whole text.

    Returns one row per input row: id, n_assign, n_access, n_hex (base spans of each kind), base_sha256 (of the base
    spans as kind:start:end, by start and kind, comma-joined), spans (base and random spans alike). Starts and ends are
    code points, ends exclusive. A null or empty text has no spans. Repeated rows get equal results; null ids are kept.
    With no candidate nothing is added. Other columns are not read. An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = own.select(
        "id",
        _kind(F.filter(matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LEAST), 0).alias("assign"),
        _kind(matches(F.col("text"), ACCESS), 1).alias("access"),
        _kind(matches(F.col("text"), HEX), 2).alias("hex"),
        candidates(F.col("text")).alias("tokens"),
    )
    battery = F.transform("tokens", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), randomness(m["found"]).alias("p")))
    tested = F.transform(F.filter(battery, lambda m: m["p"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(m["p"] >= ALPHA, written(F.rtrim(m["found"], F.lit("=")))).otherwise(1.0).alias("p")))
    found = found.select("id", "assign", "access", "hex", tested.alias("tested"))
    found = ws.keep(found, "found")
    tokens = found.select(F.explode("tested").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("n"), "t.p")
    whole = tokens.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    m, mean = whole["m"], whole["mean"] or 1.0
    cell = F.floor(-F.log10(F.greatest(F.col("p") * mean / F.col("n"), F.lit(10.0**-DECADES))) * GRID)
    counts = {r["cell"]: r["count"] for r in tokens.select(F.greatest(cell, F.lit(0)).alias("cell")).groupBy("cell").count().collect()}  # at most GRID * DECADES + 1 rows
    bound, below = 0.0, 0
    for k in range(GRID * DECADES, 0, -1):  # values in cells k and beyond are at most 10 ** (-k / GRID)
        below += counts.get(k, 0)
        if m and 10.0 ** (-k / GRID) <= level * below / m:
            bound = 10.0 ** (-k / GRID)
    base = F.concat("assign", "access", "hex")
    random = F.filter("tested", lambda t: (t["p"] * mean / (t["end"] - t["start"]) <= bound) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, _kind(random, 3))).alias("spans"),
    )
