"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything is DataFrame expressions: models are counted from labelled samples by group-by, and texts are
scanned row by row without a shuffle. Labelled samples come in kinds, which weigh alike within their label:
random strings and identifiers by rule, and as ordinary strings all words of the documents themselves, outside
what the fixed patterns find, as often as they occur (a secret is rare among them).

Base kinds (fixed patterns, leftmost and non-overlapping each): assign, access, hex. The method's kind is
markov: what base spans leave of runs of key characters, in pieces of `least` or more, of which two first-order
character models, one of random strings and one of ordinary identifiers and words, give a log-likelihood ratio
of at least `bar` nats a character. A piece below the bar is searched for its stretch of `least` or more that is
furthest above it in sum, then what lies before and behind that stretch. All must hold a letter; those without a
digit, which are words more often than not, must be `wordy` nats a character above the bar.

Places are code points, end exclusive. They follow from the lengths of a pattern's matches and of what
lies between them.

Cases: null, empty and blank texts have no spans (the digest is that of the empty string); very long texts
are scanned whole; repeated rows each give a row; without samples of either label the ratio is 0 everywhere
and nothing is added; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in order, their patterns, the group measured, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Fixed value: the characters of keys, over which the models run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
KEY = "A-Za-z0-9+/_=-"


@dataclass(frozen=True)
class SecretParams:
    least: int = 20
    bar: float = 0.35
    wordy: float = 0.35
    smooth: float = 0.5


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, random): strings from a hash, and identifiers built by joining common parts; the rule is the sample."""
    #: Fixed value: parts of ordinary identifiers.
    parts = (
        "get set add user name file list item data test main type value index count first last next page time date code key map node path size text line word order table column row batch result error handler "
        "request response client server session config option param module package version build release update delete create insert select filter group join window stream table schema reader writer buffer cache "
        "manager service factory provider adapter controller context state event message queue thread process memory storage driver executor cluster partition shuffle broadcast collect reduce format encode decode "
        "the and that this with from have will been were their there which would about other into more some than them these then only over also back after work well even want because any most between through during before"
    )
    words = F.split(F.lit(parts), " ")
    many = len(parts.split(" "))
    part = lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(many)) + 1).cast("int"))
    cap = lambda i: F.initcap(part(i))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    alnum = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    random = F.when(F.col("id") % 4 == 0, F.base64(F.unhex(digest))).when(F.col("id") % 4 == 1, alnum).when(F.col("id") % 4 == 2, F.substring(digest, 1, 40)).otherwise(F.upper(F.substring(alnum, 1, 32)))
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(99)), F.lit(3000)).cast("string")
    kinds = [
        F.concat(part(1), cap(2), cap(3), cap(4)), F.concat_ws("_", part(1), part(2), part(3), number), F.concat_ws("-", part(1), part(2), part(3), part(4)),
        F.concat_ws("/", part(1), part(2), part(3), number), F.upper(F.concat_ws("_", part(1), part(2), part(3))), F.concat(part(1), part(2), part(3), part(4), part(5)),
        F.concat(part(1), F.lit("-"), number, F.lit("-"), part(2)), F.lpad(number, 24, "2024-01-01-00-00-0000000"),
    ]
    ordinary = F.element_at(F.array(*kinds), (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int"))
    ids = spark.range(n)
    one = F.lit(1).cast("long").alias("n")
    return ids.select(random.alias("text"), F.lit(True).alias("random"), F.lit("rule").alias("kind"), one).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("random"), F.lit("rule").alias("kind"), one))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, random, kind, n): the distinct runs of key characters of all texts, outside base matches, as ordinary samples.

    Words are counted before the shuffle; what a task holds grows with distinct words, not with their number."""
    t = F.col(text).cast("string")
    for _, pattern, _, _ in BASE:
        t = F.regexp_replace(t, pattern, " ")
    runs = docs.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(t, F.lit(rf"[{KEY}]+"), F.lit(0))).alias("text"))
    return runs.groupBy("text").agg(F.count("*").alias("n")).select("text", F.lit(False).alias("random"), F.lit("words").alias("kind"), "n")


def train(samples: DataFrame, p: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratio of every pair of characters, WIDTH * WIDTH values: 0 is the start or a foreign character.

    The counts are a group-by over all samples; WIDTH^2 rows of each label and kind come back."""
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    codes = F.transform(F.filter(F.split(F.col("text"), ""), lambda c: c != ""), place)
    pairs = samples.where("text is not null and text <> '' and random is not null").select("random", "kind", "n", codes.alias("c"))
    before = F.slice(F.concat(F.array(F.lit(0)), F.col("c")), F.lit(1), F.size("c"))
    each = pairs.select("random", "kind", "n", F.explode(F.zip_with(before, "c", lambda a, b: a * WIDTH + b)).alias("at"))
    counts = each.groupBy("random", "kind", "at").agg(F.sum("n").alias("n"))
    found: dict[bool, dict[str, dict[int, int]]] = {}
    for r in counts.collect():
        found.setdefault(r["random"], {}).setdefault(r["kind"], {})[r["at"]] = r["n"]
    if len(found) < 2:
        return [0.0] * (WIDTH * WIDTH)
    mass = sum(sum(k.values()) for k in found[True].values())  # every kind of a label is brought to an equal share of this
    table = {}
    for label, kinds in found.items():
        table[label] = [p.smooth] * (WIDTH * WIDTH)
        for kind in sorted(kinds):
            scale = mass / len(kinds) / sum(kinds[kind].values())
            for at, n in kinds[kind].items():
                table[label][at] += n * scale
    out = []
    for a in range(WIDTH):
        row = slice(a * WIDTH, (a + 1) * WIDTH)
        one, two = table[True][row], table[False][row]
        out += [round(math.log(x / sum(one)) - math.log(y / sum(two)), 4) for x, y in zip(one, two, strict=True)]
    return out


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a character: positive for strings more like the random samples."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1))))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.element_at(table, s["last"] * WIDTH + c + 1)).alias("sum"))
    return F.when(F.length(text) > 0, F.aggregate(codes, start, step, lambda s: s["sum"]) / F.length(text)).otherwise(0.0)


SPANS = "array<struct<start:int,end:int,rank:int,kind:string,text:string>>"
PIECES = "array<struct<start:int,end:int>>"


def _lettered(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def _likely(text: Column, mean: Column, p: SecretParams) -> Column:
    """Random enough: at the bar, or well above it for want of a digit."""
    return _lettered(text) & (mean >= F.when(text.rlike("[0-9]"), p.bar).otherwise(p.bar + p.wordy))


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def best_stretch(text: Column, model: list[float], p: SecretParams) -> Column:
    """(sum, start, end) of the stretch of `least` characters or more whose ratios exceed the bar most in sum.

    One pass over prefix sums: the least of those that end `least` characters back is the best start."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    before = lambda c: F.concat(F.array(F.lit(0)), c)
    over = lambda c: F.transform(F.arrays_zip(F.slice(before(c), F.lit(1), F.size(c)).alias("a"), c.alias("b")), lambda x: F.element_at(table, x["a"] * WIDTH + x["b"] + 1) - p.bar)
    none = F.array_repeat(F.lit(0.0), p.least)
    zero = F.struct(F.lit(0).alias("j"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("low"), F.lit(0).alias("at"), F.lit(-1.0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        j, now, back = s["j"] + 1, s["p"] + x["x"], s["q"] + x["y"]
        lower = back < s["low"]
        at, low = F.when(lower, j - p.least).otherwise(s["at"]), F.least(back, s["low"])
        more = (j >= p.least) & (now - low > s["sum"])
        pick = lambda new, name: F.when(more, new).otherwise(s[name]).alias(name)
        return F.struct(j.alias("j"), now.alias("p"), back.alias("q"), low.alias("low"), at.alias("at"), pick(now - low, "sum"), pick(at, "start"), pick(j, "end"))

    pairs = lambda o: F.arrays_zip(o.alias("x"), F.slice(F.concat(none, o), F.lit(1), F.size(o)).alias("y"))
    found = lambda o: F.aggregate(pairs(o), zero, step, lambda s: F.struct(s["sum"].alias("sum"), s["start"].alias("start"), s["end"].alias("end")))
    return _bind(codes, lambda c: _bind(over(c), found))


def random_parts(run: Column, base: Column, model: list[float], p: SecretParams, rank: int) -> Column:
    """The random-looking spans of a run, outside the base spans."""
    no_pieces, no_spans = F.array().cast(PIECES), F.array().cast(SPANS)
    piece = lambda a, b: F.when(b - a >= p.least, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(no_pieces)
    taken = F.filter(base, lambda y: (run["start"] < y["end"]) & (y["start"] < run["end"]))
    begun = F.struct(run["start"].alias("at"), no_pieces.alias("out"))
    left = F.aggregate(
        taken, begun, lambda s, y: F.struct(F.greatest(s["at"], y["end"]).alias("at"), F.concat(s["out"], piece(s["at"], y["start"])).alias("out")),
        lambda s: F.concat(s["out"], piece(s["at"], run["end"])),
    )

    def one(a: Column, b: Column, text: Column, mean: Column) -> Column:
        return F.when(_likely(text, mean, p), F.array(F.struct(a.alias("start"), b.alias("end"), F.lit(rank).alias("rank"), F.lit("markov").alias("kind"), text.alias("text")))).otherwise(no_spans)

    def step(s: Column, _: Column) -> Column:
        head, rest = F.element_at(s["todo"], 1), F.slice(s["todo"], F.lit(2), F.size(s["todo"]))
        state = lambda todo, out: F.struct(todo.alias("todo"), F.concat(s["out"], out).alias("out"))

        def parts(t: Column) -> Column:
            def cut(g: Column) -> Column:
                a, b = head["start"] + g["start"], head["start"] + g["end"]
                more = F.concat(rest, piece(head["start"], a), piece(b, head["end"]))
                mean = g["sum"] / (g["end"] - g["start"]) + p.bar
                return F.when(g["sum"] >= 0, state(more, one(a, b, t.substr(g["start"] + 1, g["end"] - g["start"]), mean))).otherwise(state(rest, no_spans))

            searched = F.when(_lettered(t), _bind(best_stretch(t, model, p), cut)).otherwise(state(rest, no_spans))
            return _bind(ratio(t, model), lambda m: F.when(_likely(t, m, p), state(rest, one(head["start"], head["end"], t, m))).otherwise(searched))

        return F.when(F.size(s["todo"]) > 0, _bind(run["text"].substr(head["start"] - run["start"] + 1, head["end"] - head["start"]), parts)).otherwise(s)

    steps = F.sequence(F.lit(0), F.floor(F.length(run["text"]) * 3 / p.least).cast("int") + 1)
    return F.aggregate(steps, F.struct(left.alias("todo"), no_spans.alias("out")), step, lambda s: s["out"])


def spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Every match's (start, end, rank, kind, text), those kept whose group has `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        one = F.array(F.struct(a.alias("start"), b.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["hit"].alias("text")))
        keep = F.when(F.length(x["held"]) >= least, F.concat(s["out"], one)).otherwise(s["out"])
        return F.struct(b.alias("at"), keep.alias("out"))

    pairs = F.zip_with(F.arrays_zip(found.alias("hit"), held.alias("held")), F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m["hit"].alias("hit"), m["held"].alias("held")))
    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(none)


def find(docs: DataFrame, model: list[float], p: SecretParams = SecretParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, markov): the base spans and the added ones of every row, each sorted by start and kind."""
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    run = rf"(?<![{KEY}])[{KEY}]{{{p.least},}}"
    kinds = [spans(t, pattern, group, least, kind, i) for i, (kind, pattern, group, least) in enumerate(BASE)]
    made = rows.select(key, F.array_sort(F.concat(*kinds)).alias("base"), spans(t, run, 0, p.least, "markov", len(BASE)).alias("runs"))
    added = F.array_sort(F.flatten(F.transform(F.filter("runs", lambda x: _lettered(x["text"])), lambda x: random_parts(x, F.col("base"), model, p, len(BASE)))))
    return made.select(key, "base", F.when(F.size("runs") > 0, added).otherwise(F.col("runs")).alias("markov"))


def listed(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts and lists of find()."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.array_sort(F.concat("base", "markov"))
    return found.select(key, *[count(k) for k, *_ in BASE], F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(both).alias("spans"))
