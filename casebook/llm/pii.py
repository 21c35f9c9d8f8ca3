"""Personal data: base patterns, loose candidate generators, and boosted trees that choose among candidates.

Native throughout: patterns, offsets, features and trees are column expressions.

* The four base kinds (email, ip, card, phone) are leftmost non-overlapping matches
  that pass their check; they always stay.
* High-recall generators (`GENERATORS`) propose further spans, which may overlap each
  other. Those that overlap a base span are dropped, except letters around a card number;
  `features` describes the others by format and by the text on both sides. Secrets have
  no greatest length.
* `fit` boosts regression trees on labelled candidates (logistic loss). Thresholds are
  calibrated on candidates held out from the fit: for each kind the lowest score that
  keeps precision at ``PRECISION``. The labelled candidates are made here by rule
  (`labelled`, ``TRAIN_ROWS`` of them, a fixed seed), so the model is the same for any input.

Offsets are code points, ends exclusive. Spark has no function for the offsets of all
matches; they follow from ``split``, which returns what lies between the matches that
``regexp_extract_all`` returns. Offsets, overlaps and redacted texts are running sums and maxima over
blocks (`running`), and pieces of a text are taken from its cut into equal lengths (`part`), so a text with very many matches costs
little more than their number.

Defined cases: a null or empty text has no spans; an empty table gives no rows. Rows are judged each by itself, so
ties and repeated rows need no rule. Very long texts and values are judged whole. `detect` reads the id and text alone and `redact` numbers the
other columns, so their names cannot clash.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import documents

TRAIN_ROWS = 4000
TREES, RATE, PRECISION = 24, 0.4, 0.98
CONTEXT = 24
BLOCK, PART = 128, 64

# The base patterns, written so that no start inside a run is tried after the run's first
# (a match that starts inside would also start at the run's first, or where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "mail_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]{2,} ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[A-Za-z]{2,}\b",
    "national_phone": r"(?<![0-9])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "assigned": r"(?i)(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*?(?:key|token|secret|passw[o0]rd|pwd|auth))[A-Za-z0-9_]++ ?[=:] ?[\"']?[^\s\"']{6,}+[\"']?",
    "long_token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])",
}
KINDS = (*BASE, *GENERATORS)
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(xs: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``op`` makes of those before it, by sums of blocks and then within blocks."""

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))), lambda c: F.aggregate(F.slice(v, c * BLOCK + 1, F.lit(BLOCK)), zero, op))
        firsts = lambda sums: F.transform(sums, lambda _, c: F.aggregate(F.slice(sums, F.lit(1), c), zero, op))
        within = lambda at: F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.get(at, F.floor(i / BLOCK).cast("int")), op))
        return let(let(blocks, firsts), within)

    return let(xs, whole)


def parts(text: Column) -> Column:
    """The text cut into pieces of ``PART`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """What `parts` holds from start to end."""
    first = F.floor(start / PART).cast("int")
    held = F.array_join(F.slice(cut, first + 1, F.floor((end - 1) / PART).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * PART + 1, end - start)).otherwise("")


def located(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """array<SPAN> of all matches; ``found`` holds their values, an earlier column, so they are matched once."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
    sized = F.zip_with(gaps, found, lambda gap, value: F.struct(gap.alias("gap"), F.length(value).alias("n"), value.alias("value")))

    def spans(z: Column) -> Column:
        before = running(F.transform(z, lambda x: x["gap"] + x["n"]), F.lit(0), lambda a, x: a + x)

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"))

        return F.zip_with(z, before, span)

    return F.when(F.size(found) > 0, let(sized, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


#: What a base match must pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


# ---- the trees -------------------------------------------------------------------------------


class Feature(NamedTuple):
    """A number from a candidate's kind, value, and the text left and right of it; ``pattern`` None: the value's length."""

    name: str
    of: str
    pattern: str | None


FEATURES = (
    *(Feature(f"is_{k}", "kind", f"^{k}$") for k in GENERATORS),
    Feature("length", "value", None),
    Feature("has_lower", "value", "[a-z]"),
    Feature("has_upper", "value", "[A-Z]"),
    Feature("mixed", "value", "[A-Za-z][0-9]+[A-Za-z]"),
    Feature("hex_run", "value", "(?:^|[^0-9a-f])[0-9a-f]{32,}"),
    Feature("key_prefix", "value", "^(?:AKIA|ASIA|sk-|ghp_|xox)"),
    Feature("brackets", "value", "[\\[(](?:at|dot)[\\])]"),
    Feature("known_ending", "value", "(?:com|org|net|edu|info|de|fr|es|io)$"),
    Feature("area_in_parentheses", "value", "^\\([0-9]{3}\\)"),
    Feature("bad_area", "value", "^\\(?(?:000|666|9[0-9]{2}|[01][0-9]{2})"),
    Feature("quoted", "value", "[\"']"),
    Feature("digit_in_secret", "value", "[=:].*[0-9]"),
    Feature("words_only", "value", "[=:] ?[\"']?[a-z]+[\"',.]*$"),
    Feature("digits_only", "value", "^[0-9]+$"),
    Feature("path_like", "value", "/.*/|--|__"),
    Feature("asks_phone", "left", "(?i)(?:phone|tel|call|fax|mobile|cell)[^A-Za-z]{0,12}$"),
    Feature("asks_id", "left", "(?i)(?:ssn|social|security|tax|iban|account|id)[^A-Za-z]{0,12}$"),
    Feature("asks_mail", "left", "(?i)(?:mail|contact|write|reach)[^A-Za-z]{0,12}$"),
    Feature("asks_code", "left", "(?i)(?:commit|sha|md5|hash|version|build|order|part|isbn|no)[^A-Za-z]{0,6}$"),
    Feature("in_url", "left", "(?:://|www\\.)[^ ]*$"),
    Feature("joined_left", "left", "[A-Za-z0-9.+-]$"),
    Feature("joined_right", "right", "^[A-Za-z0-9-]"),
)


def _feature_columns(kind: Column, value: Column, left: Column, right: Column) -> list[Column]:
    parts = {"kind": kind, "value": value, "left": left, "right": right}
    return [F.length(parts[f.of]).cast("double") if f.pattern is None else F.when(F.rlike(parts[f.of], F.lit(f.pattern)), 1.0).otherwise(0.0) for f in FEATURES]


def feature_values(kind: str, value: str, left: str, right: str) -> list[float]:
    """The same features of one labelled candidate, for `fit`."""
    import re

    parts = {"kind": kind, "value": value, "left": left, "right": right}
    return [float(len(parts[f.of])) if f.pattern is None else float(bool(re.search(f.pattern, parts[f.of]))) for f in FEATURES]


def labelled(rows: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[tuple[str, str, str, str], int]]:
    """((kind, value, left, right), 1 if personal) made by rule, half of each kind personal."""
    rng = random.Random(seed)
    word = lambda n=6: "".join(rng.choice("abdefghilmnorstu") for _ in range(rng.randint(3, n)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n))
    pick = rng.choice
    plain = lambda: f"{word()} {word()} {word()} "
    good: dict[str, Callable[[], tuple[str, str]]] = {
        "mail_words": lambda: (f"{word(pick([6, 14]))}{pick(['', '.' + word()])} {pick(['[at]', '(at)'])} {word(pick([6, 14]))} {pick(['[dot]', '(dot)', 'dot'])} {pick(['com', 'org', 'net', 'de'])}", pick([plain(), plain() + "mail: "])),
        "national_phone": lambda: pick([(f"({pick('23456789')}{digits(2)}) {digits(3)}-{digits(4)}", plain()), (f"{pick('2345678')}{digits(2)}-{digits(3)}-{digits(4)}", plain() + pick(["call ", "tel. ", "phone: "]))]),
        "ssn": lambda: (f"{pick('12345')}{digits(2)}-{digits(2)}-{digits(4)}", pick([plain(), plain() + "SSN "])),
        "iban": lambda: (f"{pick(['DE', 'FR', 'ES', 'GB'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", pick([plain(), plain() + "IBAN "])),
        "assigned": lambda: (f"{pick(['token', 'api_key', 'secret', 'passw0rd', 'password', 'auth_key'])}{pick([' = ', '=', ': '])}{pick(['', chr(34)])}{pick([hexes(40), hexes(16) + upper(6), word() + digits(6), upper(20)])}", plain()),
        "long_token": lambda: (pick(["AKIA" + upper(16), hexes(40), hexes(64), "ghp_" + upper(30), word() + upper(24) + word()]), plain()),
    }
    bad: dict[str, Callable[[], tuple[str, str]]] = {
        "mail_words": lambda: (f"{word(pick([6, 14, 24]))} at {word(pick([6, 14, 24]))}{pick(['. ', '.', ' dot '])}{pick([word(14), word(14).capitalize()])}", pick([plain(), plain() + "mail: "])),
        "national_phone": lambda: (f"{pick('019')}{digits(2)} {digits(3)} {digits(4)}", plain() + pick(["", "part no ", "order ", "isbn "])),
        "ssn": lambda: (f"{pick(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}", plain() + pick(["", "part no ", "version "])),
        "iban": lambda: (f"{upper(2).translate(str.maketrans('0123456789', 'ABCDEFGHIJ'))}{digits(2)}{upper(12)}", plain() + pick(["part no ", "order ", "build "])),
        "assigned": lambda: (f"{pick(['key', 'token', 'secret', 'author', 'keyword'])}: {word(9)}{word(9)}{pick(['', ',', '.'])}", plain()),
        "long_token": lambda: (pick([f"{word()}-{word()}-{word()}-{digits(2)}", f"/{word()}/{word()}/{word()}{digits(4)}", f"{word(9)}{word(9)}{word(9)}{digits(2)}", "-" * 16 + digits(1), hexes(40), digits(16), digits(rng.randint(16, 24))]), ""),
    }
    made = []
    for k in range(rows):
        kind, personal = tuple(GENERATORS)[k % len(GENERATORS)], (k // len(GENERATORS)) % 2
        value, left = (good if personal else bad)[kind]()
        if kind == "long_token" and not personal:
            left = pick(["commit ", "sha ", "md5 "]) if set(value) <= set("0123456789abcdef") and not value.isdigit() else pick([plain(), "https://" + word() + "/"])
        made.append(((kind, value, left[-CONTEXT:], pick([" ", ".", ",", ""])), personal))
    return made


class Trees(NamedTuple):
    """Trees of depth two: (feature, cut, left child, right child) with (feature, cut, value below, value above) as children."""

    start: float
    trees: tuple
    thresholds: dict[str, float]


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, float, float]:
    """(gain, feature, cut, value below, value above) of the split with most gain."""
    total, best = g.sum() ** 2 / (h.sum() + 1), (0.0, 0, 0.5, g.sum() / (h.sum() + 1), g.sum() / (h.sum() + 1))
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], [0.1, 0.25, 0.5, 0.75, 0.9])) + 0.5 if x[:, f].max(initial=0) > 1 else (0.5,):
            low = x[:, f] < cut
            gl, hl = g[low].sum(), h[low].sum()
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total
            if gain > best[0] + 1e-9:
                best = (gain, f, float(cut), gl / (hl + 1), gr / (hr + 1))
    return best


def _raw(start: float, trees: tuple, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), start)
    for f, cut, below, above in trees:
        for side, (f2, cut2, a, b) in ((x[:, f] < cut, below), (x[:, f] >= cut, above)):
            out[side] += np.where(x[side][:, f2] < cut2, a, b)
    return out


@cache
def fit(rows: int = TRAIN_ROWS) -> Trees:
    """Boost on three quarters of `labelled`, calibrate the thresholds on the last quarter."""
    made = labelled(rows)
    x = np.array([feature_values(*c) for c, _ in made])
    y = np.array([label for _, label in made], float)
    held = np.arange(len(y)) // (2 * len(GENERATORS)) % 4 == 3  # whole rounds of kinds and labels
    xs, ys, trees = x[~held], y[~held], ()
    start = float(np.log(ys.mean() / (1 - ys.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-_raw(start, trees, xs)))
        g, h = ys - p, p * (1 - p)
        _, f, cut, *_ = _best_split(xs, g, h)
        sides = []
        for side in (xs[:, f] < cut, xs[:, f] >= cut):
            _, f2, cut2, a, b = _best_split(xs[side], g[side], h[side])
            sides.append((f2, cut2, float(a * RATE), float(b * RATE)))
        trees += ((f, cut, *sides),)
    score = 1 / (1 + np.exp(-_raw(start, trees, x[held])))
    kinds, thresholds = np.array([c[0] for (c, _), h in zip(made, held, strict=True) if h]), {}
    for kind in GENERATORS:
        s, t = score[kinds == kind], y[held][kinds == kind]
        kept = [c for c in np.unique(s) if t[s >= c].mean() >= PRECISION]
        least = float(min(kept, default=1.0))
        thresholds[kind] = max(0.5, (least + float(s[s < least].max(initial=0.0))) / 2)  # halfway to the next score below
    return Trees(start, trees, thresholds)


def score(model: Trees, features: list[Column]) -> Column:
    """The trees as one expression."""

    def leaf(node: tuple) -> Column:
        f, cut, a, b = node
        return F.when(features[f] < cut, F.lit(a)).otherwise(F.lit(b))

    raw = reduce(lambda s, t: s + F.when(features[t[0]] < t[1], leaf(t[2])).otherwise(leaf(t[3])), model.trees, F.lit(model.start))
    return 1 / (1 + F.exp(-raw))


def passes(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: check(span["value"])


# ---- spans -----------------------------------------------------------------------------------


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """Adds ``base`` and ``added``, each array<SPAN> ordered by kind as listed in `KINDS`, then start."""
    model = model or fit()
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in (BASE | GENERATORS).items()))
    spans = found.select(
        *docs.columns,
        F.concat(*(F.filter(located(text, F.col(f"_{k}"), p, k), passes(CHECKS[k])) for k, p in BASE.items())).alias("base"),
        F.concat(*(located(text, F.col(f"_{k}"), p, k) for k, p in GENERATORS.items())).alias("_loose"),
    )

    def chosen(span: Column, cut: Column) -> Column:
        left = part(cut, F.greatest(F.lit(0), span["start"] - CONTEXT), span["start"])
        right = part(cut, span["end"], span["end"] + 2)
        of = F.struct(span["kind"].alias("kind"), span["value"].alias("value"), left.alias("left"), right.alias("right"))
        numbers = let(of, lambda x: F.array(*_feature_columns(x["kind"], x["value"], x["left"], x["right"])))
        scores = let(numbers, lambda x: score(model, [x[i] for i in range(len(FEATURES))]))
        threshold = reduce(lambda c, k: c.when(span["kind"] == k, F.lit(model.thresholds[k])), GENERATORS, F.when(F.lit(False), F.lit(1.0)))
        return scores >= threshold

    far = F.lit((1 << 31) - 1)
    order = F.array(*map(F.lit, GENERATORS))

    def entry(s: Column, base: bool) -> Column:
        """Any span in order of its start, with where it ends for others if it is a base span (and no card), and what it is."""
        plain = s["kind"] != "card"
        secret = s["kind"].isin("assigned", "long_token") & F.rlike(s["value"], F.lit("[A-Za-z]"))
        end, start = (s["end"], s["start"]) if base else (F.lit(0), far)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("stop"), F.lit(base).alias("base"), end.alias("end"), F.when(plain, end).otherwise(0).alias("plain_end"),
            start.alias("from"), F.when(plain, start).otherwise(far).alias("plain_from"), secret.alias("secret"), F.array_position(order, s["kind"]).alias("n"), s.alias("span"),
        )

    def apart(entries: Column) -> Column:
        """The loose spans that no base span overlaps. Digits in a secret may be a card number by chance; the secret around them is still one."""
        two = lambda a, b: F.struct(a.alias("any"), b.alias("plain"))
        ends = running(F.transform(entries, lambda x: two(x["end"], x["plain_end"])), two(F.lit(0), F.lit(0)), lambda a, x: two(F.greatest(a["any"], x["any"]), F.greatest(a["plain"], x["plain"])))
        backwards = F.reverse(F.transform(entries, lambda x: two(x["from"], x["plain_from"])))
        starts = F.reverse(running(backwards, two(far, far), lambda a, x: two(F.least(a["any"], x["any"]), F.least(a["plain"], x["plain"]))))
        met = F.arrays_zip(entries.alias("x"), ends.alias("before"), starts.alias("after"))

        def free(m: Column) -> Column:
            x, pick = m["x"], lambda side: F.when(m["x"]["secret"], m[side]["plain"]).otherwise(m[side]["any"])
            return ~x["base"] & (pick("before") <= x["start"]) & (pick("after") >= x["stop"])

        kept = F.transform(F.filter(met, free), lambda m: F.struct(m["x"]["n"].alias("n"), m["x"]["start"].alias("start"), m["x"]["span"].alias("span")))
        return F.transform(F.array_sort(kept), lambda m: m["span"])

    entries = F.array_sort(F.concat(F.transform("base", lambda s: entry(s, True)), F.transform("_loose", lambda s: entry(s, False))))
    mixed = (F.size("_loose") > 0) & (F.size("base") > 0)
    return spans.withColumn("_apart", F.when(mixed, let(entries, apart)).otherwise(F.col("_loose"))).select(
        *docs.columns, "base", F.when(F.size("_apart") > 0, let(parts(text), lambda cut: F.filter("_apart", lambda s: chosen(s, cut)))).otherwise(F.col("_apart")).alias("added")
    )


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and added spans of every row."""
    return find(documents(df, id_col, text_col))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; null texts stay null. Same columns."""
    names = docs.columns
    own = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(text_col).alias("text"))
    sorted_spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def clean(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))

        def joined(cut: Column) -> Column:
            put = lambda s, at: F.when(s["start"] >= at, F.concat(part(cut, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(F.zip_with(spans, before, put), ""), part(cut, last, F.length("text")))

        return let(parts(F.col("text")), joined)

    done = find(own).withColumn("_clean", F.when(F.size("base") + F.size("added") > 0, let(sorted_spans, clean)).otherwise(F.col("text")))
    return done.select(*(F.col("_clean" if c == text_col else f"c{k}").alias(c) for k, c in enumerate(names)))
