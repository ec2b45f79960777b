"""Personal data and secrets: gradient-boosted selection among overlapping candidate spans, in SQL functions only.

Base spans of four kinds are leftmost matches of fixed patterns that pass a check
(address parts, Luhn, digit counts); they always stand. High-recall generators
propose further spans: digit runs and groups inside failed card and phone matches,
national phone numbers, addresses with a spelt-out at sign, and as a fifth kind,
``secret``, values assigned to a telling name, values with an issuer's prefix and long
runs of mixed letters and digits.

Every candidate is described by its format (digits, length, letters, separators) and
its context (neighbouring characters, a telling word before it) and gets a label from
evidence that its description withholds: an address by its last part, an IP address,
card or phone number by its check, a national number by a telling word, a secret by
the name it is assigned to or its issuer's prefix. Boosted trees learn the labels on
half of the texts. On the other half their scores are calibrated, kind by kind, by
isotonic regression; a card number that passes Luhn may do so by chance, which is
taken off. The threshold of a kind is the lowest score from which on the calibrated
share of true spans is ``PRECISION``. A candidate is added if it reaches it, passes
the check of its kind and overlaps no base span; of overlapping ones the best stays.

Everything over texts is native: split() gives the gaps between matches and
regexp_extract_all() the matches, so a running sum of their lengths is a match's
place, and a match's neighbourhood is the end of the gap before it. Candidates are
found once and written. Training data are counts per distinct feature vector, a
table whose size the feature domains bound; only it reaches the driver, and the
fitted trees go back as one SQL expression.

Edge cases: a null text is an empty one; a text without candidates has no spans;
a kind with too few labelled candidates adds nothing; repeated rows each get a
row; of candidates that tie the first in place, then in generator order, stays; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.scratch import Scratch

#: Kinds of base spans, in the order in which spans are listed; ``secret`` is only added.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns, with possessive repeats and starts only where a run of the
#: first class begins: the same matches, in time linear in the text.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur for a pattern to match at all.
MUST = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
_RUN = "[A-Za-z0-9+/_=-]"
#: Names that secrets are assigned to, and prefixes by which issuers mark theirs (fixed values).
SECRET_NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential"
ISSUER_PREFIXES = ["AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "sk_live_", "sk-"]
ISSUERS = "|".join(ISSUER_PREFIXES)
_ASSIGNED = rf"(?i:{SECRET_NAMES})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
#: Generators over failed base matches and over whole texts: (name, kind, pattern), and what must occur.
INSIDE = [("card_run", "card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"), ("card_groups", "card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"), ("phone_head", "phone", r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")]
OUTSIDE = [
    ("phone_national", "phone", r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[.-][0-9]{4}"),
    ("email_spelt", "email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++[\x20]?[\[(]at[\])][\x20]?{_HOST}++(?:[\x20]?(?:\.|[\[(]dot[\])])[\x20]?{_HOST}++)++", r"[\[(]at[\])]"),
    ("secret_assigned", "secret", rf"(?<={_ASSIGNED}){_RUN}{{8,}}+", _ASSIGNED + _RUN),
    ("secret_issued", "secret", rf"(?<!{_RUN})(?:{ISSUERS}){_RUN}{{12,}}+", ISSUERS),
    ("secret_dense", "secret", rf"(?<!{_RUN})(?=[A-Za-z+/_=-]{{0,64}}[0-9])(?=[0-9+/_=-]{{0,64}}[A-Za-z]){_RUN}{{16,}}+", rf"[0-9]{_RUN}{{7}}|{_RUN}{{7}}[0-9]"),
]
GENERATORS = ["base", *(g[0] for g in INSIDE), *(g[0] for g in OUTSIDE)]

#: Words that tell of personal data when they stand shortly before it (fixed values).
CUES = r"(?i)(?:mail|e-mail|correo|kontakt|contact|tel|phone|mobile|fax|call|rufnummer|t[eé]l[eé]phone|card|visa|karte|carte|tarjeta|credit|ip|host|server|addr)[^A-Za-z0-9]{0,4}(?:[a-z]{0,12}[^A-Za-z0-9]{1,4})?$"
BEFORE = 24
#: Matches whose places are summed up in one go.
BLOCK = 256

FEATURES = ["kind", "digits", "size", "letters", "separators", "left", "right", "cue"]
ROUNDS, RATE = 12, 0.5
#: Share of true spans that a threshold asks of a kind's added spans, and how often chance passes a kind's check.
PRECISION, CHANCE = 0.8, {"card": 0.1}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(9, 15)


_SPAN = "struct<start:bigint,end:bigint,match:string,before:string,after:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, must: str, offset: Column | None = None, before: Column | None = None) -> Column:
    """array of (start, end, match, before, after) of all matches of a pattern, places in code points; before and after reach to the next match."""
    none = F.array().cast(f"array<{_SPAN}>")
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def steps(c: Column) -> Column:
        n = F.size(c["found"])
        own = F.zip_with(F.slice(c["gaps"], 1, n), c["found"], lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.zip_with(own, F.slice(c["gaps"], 2, n), lambda s, g: F.struct(s["gap"].alias("gap"), s["m"].alias("m"), F.substring(g, 1, 1).alias("after")))

    def walk(acc: Column, step: Column) -> Column:
        start = acc["at"] + F.length(step["gap"])
        end = start + F.length(step["m"])
        near = F.substring(step["gap"], -BEFORE, BEFORE)
        if before is not None:
            near = F.when(F.length(step["gap"]) == 0, before).otherwise(near)
        one = F.struct(start.alias("start"), end.alias("end"), step["m"].alias("match"), near.alias("before"), step["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(all_steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_steps, i * BLOCK + 1, F.lit(BLOCK)))

        def block(acc: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), walk)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        first = F.struct((F.lit(0).cast("long") if offset is None else offset).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.when(F.size(all_steps) == 0, none).otherwise(F.aggregate(blocks, first, block, lambda acc: F.flatten(acc["out"])))

    return F.when(_may(text, must), _let(_let(cut, steps), placed)).otherwise(none)


def _may(text: Column, must: str) -> Column:
    """Whether what a pattern needs occurs; plain searches stand before slow patterns."""
    if must == ISSUERS:
        return reduce(or_, (F.contains(text, F.lit(p)) for p in ISSUER_PREFIXES))
    return text.rlike("[=:]") & text.rlike(must) if must.startswith(_ASSIGNED) else text.rlike(must)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or white space, 1 digit, 2 letter, 3 quote, 4 other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("[0-9]"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[\"'`]"), 3).otherwise(4)


def _mask(text: Column, patterns: list[str]) -> Column:
    return sum((F.when(text.rlike(p), 1 << k).otherwise(0) for k, p in enumerate(patterns)), F.lit(0))


def _described(span: Column, kind: str, generator: str) -> Column:
    """A candidate: its features, whether it passes its check, and its label from evidence that is no feature."""
    m, before = span["match"], span["before"]
    n = F.length(_digits(m))
    cued = before.rlike(CUES)
    valid = n == 10 if generator == "phone_national" else F.lit(True) if kind == "secret" else _passes(kind, m)
    if kind == "email":
        label = m.rlike(r"(?i)[.\])\x20][a-z]{2,24}$")
    elif kind == "secret":
        label = before.rlike(f"{_ASSIGNED}$") | m.rlike(f"^(?:{ISSUERS})")
    else:
        label = cued if generator == "phone_national" else valid
    withheld = kind == "secret" or generator == "phone_national"
    return F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("kind"),
        F.lit(GENERATORS.index(generator)).alias("generator"),
        F.least(n, F.lit(24)).alias("digits"),
        F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int").alias("size"),
        (_mask(m, ["[a-f]", "[A-F]", "[g-z]", "[G-Z]"]) if kind == "secret" else F.lit(0)).alias("letters"),
        _mask(m, ["[+/_=-]"] if kind == "secret" else ["[\\x20]", "-", "[.]", "[(\\[]"]).alias("separators"),
        _side(F.substring(before, -1, 1)).alias("left"),
        _side(span["after"]).alias("right"),
        (F.lit(2) if withheld else cued.cast("int")).alias("cue"),
        valid.alias("valid"),
        label.alias("label"),
        span["start"].alias("start"),
        span["end"].alias("end"),
    )


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, half (of training or of calibration), base (array of kind, start, end of passing matches) and found (array of described candidates)."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    text = F.col("__text")
    rows = rows.select(*keep, "__text", *(_matches(text, BASE[k], MUST[k]).alias(f"__{k}") for k in KINDS))

    def described(spans: Column, kind: str, generator: str) -> Column:
        return F.transform(spans, lambda s: _described(s, kind, generator))

    def inside(kind: str, pattern: str) -> Column:
        failed = F.filter(F.col(f"__{kind}"), lambda s: ~_passes(kind, s["match"]))
        return F.flatten(F.transform(failed, lambda s: _matches(s["match"], pattern, pattern, s["start"], s["before"])))

    def passing(kind: str) -> Column:
        spans = F.filter(F.col(f"__{kind}"), lambda s: _passes(kind, s["match"]))
        return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = [described(F.col(f"__{k}"), k, "base") for k in KINDS]
    found += [described(inside(kind, pattern), kind, name) for name, kind, pattern in INSIDE]
    found += [described(_matches(text, pattern, must), kind, name) for name, kind, pattern, must in OUTSIDE]
    half = F.pmod(F.xxhash64("__text"), F.lit(2)).cast("int")
    return rows.select(*keep, half.alias("__half"), F.concat(*map(passing, KINDS)).alias("__base"), F.concat(*found).alias("__found"))


class Trees:
    """Boosted trees of depth two over small whole numbers, and a threshold for each kind."""

    def __init__(self, bias: float, trees: list, thresholds: list[float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def score(self, row: dict) -> float:
        total = self.bias
        for f, cut, low, high in self.trees:
            g, c, a, b = high if row[f] > cut else low
            total += b if row[g] > c else a
        return total

    def expression(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for f, cut, low, high in self.trees:
            leaf = [F.when(c[g] > t, F.lit(b)).otherwise(F.lit(a)) for g, t, a, b in (low, high)]
            total = total + F.when(c[f] > cut, leaf[1]).otherwise(leaf[0])
        return total

    def selects(self, c: Column) -> Column:
        """Whether a candidate with its score reaches the threshold of its kind."""
        wanted = F.lit(False)
        for k, t in enumerate(self.thresholds):
            if math.isfinite(t):
                wanted = wanted | ((c["kind"] == k) & (c["score"] >= t))
        return wanted


def _best_split(rows: list, g: list, h: list, ids: list[int], features: list[str]):
    """(gain, feature, cut, low value, high value) of the best two-way split of some rows."""
    total_g, total_h = sum(g[i] for i in ids), sum(h[i] for i in ids)
    score = lambda a, b: a * a / (b + 1.0)
    best = (0.0, features[0], math.inf, total_g / (total_h + 1), 0.0)
    for f in features:
        sums: dict[int, list[float]] = {}
        for i in ids:
            s = sums.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += g[i]
            s[1] += h[i]
        left_g = left_h = 0.0
        values = sorted(sums)
        for v in values[:-1]:
            left_g, left_h = left_g + sums[v][0], left_h + sums[v][1]
            gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
            if gain > best[0] + 1e-12:
                best = (gain, f, v, left_g / (left_h + 1), (total_g - left_g) / (total_h - left_h + 1))
    return best


def fit(rows: list[dict]) -> Trees:
    """Trees from feature vectors with counts ``good`` and ``bad``, thresholds from ``held_good`` and ``held_bad``."""
    bias = math.log((sum(r["good"] for r in rows) + 1) / (sum(r["bad"] for r in rows) + 1))
    scores, trees = [bias] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [r["good"] - (r["good"] + r["bad"]) * q for r, q in zip(rows, p, strict=True)]
        h = [(r["good"] + r["bad"]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        every = list(range(len(rows)))
        gain, f, cut, _, _ = _best_split(rows, g, h, every, FEATURES)
        if gain <= 1e-6:
            break
        leaves = []
        for part in ([i for i in every if rows[i][f] <= cut], [i for i in every if rows[i][f] > cut]):
            _, g2, c2, a, b = _best_split(rows, g, h, part, FEATURES)
            leaves.append((g2, c2 if math.isfinite(c2) else 1 << 20, RATE * a, RATE * b))
        trees.append((f, cut, *leaves))
        scores = [s + (leaves[r[f] > cut][3] if r[leaves[r[f] > cut][0]] > leaves[r[f] > cut][1] else leaves[r[f] > cut][2]) for s, r in zip(scores, rows, strict=True)]
    return Trees(bias, trees, [_threshold(k, rows, scores) for k in range(len(ALL_KINDS))])


def calibrated(points: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Isotonic regression of (score, good, bad): blocks (lowest score, good, bad) whose share of good rises with the score."""
    blocks: list[tuple[float, int, int]] = []
    for score, good, bad in sorted(points):
        blocks.append((score, good, bad))
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][1] * (blocks[-1][1] + blocks[-1][2]) >= blocks[-1][1] * (blocks[-2][1] + blocks[-2][2])):
            (s, a, b), (_, c, d) = blocks[-2:]
            blocks[-2:] = [(s, a + c, b + d)]
    return blocks


def _threshold(kind: int, rows: list[dict], scores: list[float]) -> float:
    """The lowest score of a block of held-out candidates that are true spans, given that they pass, often enough."""
    own = [(s, r["held_good"], r["held_bad"]) for s, r in zip(scores, rows, strict=True) if r["kind"] == kind and r["held_good"] + r["held_bad"]]
    chance = CHANCE.get(ALL_KINDS[kind], 0.0)
    for score, good, bad in calibrated(own):
        share = good / (good + bad + 1)
        if share > chance and (share - chance) / (1 - chance) / share >= PRECISION and (chance or share >= PRECISION):
            return score - 1e-9
    return math.inf


def train(found: DataFrame) -> Trees:
    """Trees and thresholds from all candidates."""
    seen = found.select("__half", F.explode("__found").alias("c")).select("__half", "c.*")
    names = {"good": (0, True), "bad": (0, False), "held_good": (1, True), "held_bad": (1, False)}
    counts = seen.groupBy(*FEATURES).agg(*(F.count_if((F.col("__half") == half) & (F.col("label") == label)).alias(c) for c, (half, label) in names.items()))
    return fit(sorted((r.asDict() for r in counts.collect()), key=lambda r: [r[f] for f in FEATURES]))  # one row per feature vector


_PLACED = "struct<start:bigint,end:bigint,kind:int,generator:int,score:double>"


def _best(base: Column, chosen: Column) -> Column:
    """Of the chosen candidates those that overlap no base span, and of a run of overlapping ones the best: one sweep by start."""
    given = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(0).alias("generator"), F.lit(0.0).alias("score")))
    own = F.transform(chosen, lambda c: F.struct(*(c[f].alias(f) for f in ("start", "end", "kind", "generator", "score"))))
    every = F.array_sort(F.concat(given, own).cast(f"array<{_PLACED}>"), lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["generator"] - y["generator"])).cast("int"))
    none = F.array().cast(f"array<{_PLACED}>")

    def step(acc: Column, s: Column) -> Column:
        held, is_base = acc["held"], s["generator"] == 0
        holds = F.size(held) == 1
        meets = holds & (s["start"] < held[0]["end"])
        blocked = ~is_base & (s["start"] < acc["top"])
        stays = is_base | blocked | (meets & (s["score"] <= held[0]["score"]))
        now = F.when(is_base, none).when(stays, held).otherwise(F.array(s))
        now = F.when(blocked, held).otherwise(now)
        done = F.when(holds & ~meets & ~blocked, F.concat(acc["out"], held)).otherwise(acc["out"])
        top = F.when(is_base, F.greatest(acc["top"], s["end"])).otherwise(acc["top"])
        return F.struct(top.alias("top"), now.alias("held"), done.alias("out"))

    first = F.struct(F.lit(-1).cast("long").alias("top"), none.alias("held"), none.alias("out"))
    return F.aggregate(every, first, step, lambda acc: F.concat(acc["out"], acc["held"]))


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (default doc_id), base and spans: arrays of (kind, start, end), sorted by kind and start."""
    keep = keep or ["doc_id"]
    found = Scratch(docs.sparkSession).write(candidates(docs, keep), "candidates")
    trees = train(found)
    scored = F.transform(F.filter("__found", lambda c: (c["generator"] > 0) & c["valid"]), lambda c: F.struct(*(c[f].alias(f) for f in ("start", "end", "kind", "generator")), trees.expression(c).alias("score")))
    added = F.transform(_best(F.col("__base"), F.filter(scored, trees.selects)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select(*keep, F.array_sort("__base").alias("base"), F.array_sort(F.concat("__base", added)).alias("spans"))


def _listed(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_secret (added) and n_added of every row."""
    rows = detect(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(count, range(len(KINDS)))
    return rows.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == len(KINDS))).cast("long").alias("n_secret"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


#: Code points of a block that a span is looked up in, and spans that are put together before they join what came before.
BLOCK = 512
RUN = 256


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The text from code point a to before b: of blocks, not from the text's start."""
    i, j = (F.floor(x / BLOCK).cast("int") for x in (a, b - 1))
    place = lambda x: F.pmod(x, F.lit(BLOCK)).cast("int") + 1
    inner = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    several = F.concat(F.substring(F.get(blocks, i), place(a), F.lit(BLOCK)), inner, F.substring(F.get(blocks, j), F.lit(1), place(b - 1)))
    return F.when(b <= a, "").when(i == j, F.substring(F.get(blocks, i), place(a), (b - a).cast("int"))).otherwise(several)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind's mark.

    Linear in the text and the spans: the text is cut into blocks once, each gap
    is taken from its blocks, and pieces are joined run by run of spans.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in ALL_KINDS))
    none = F.array().cast("array<string>")

    def masked(given: Column) -> Column:
        blocks, placed = given["blocks"], given["ordered"]

        def walk(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.array(_between(blocks, acc["at"], s["start"]), F.element_at(marks, s["kind"] + 1)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        def run(acc: Column, own: Column) -> Column:
            made = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), walk)
            return _let(made, lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(m["out"], ""))).alias("out")))

        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(placed), F.lit(1)), F.lit(RUN)), lambda k: F.slice(placed, k, RUN))
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(runs, start, run, lambda acc: F.concat(F.array_join(acc["out"], ""), _between(blocks, acc["at"], given["n"])))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(F.struct(blocks.alias("blocks"), ordered.alias("ordered"), F.length(text).cast("long").alias("n")), masked)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked, columns unchanged; ``n_chars``, where there is one, follows a changed text.

    Rows in which no pattern can match pass as they are; only the others are written with their candidates.
    """
    rest = [_may(F.col("text"), g[3]) for g in OUTSIDE if not g[3].startswith("[0-9]")]  # every other pattern needs a digit or an at sign
    may = F.coalesce(reduce(or_, [F.col("text").rlike("[0-9@]"), *rest]), F.lit(False))
    asked = docs.filter(may)
    rows = detect(asked.withColumn("__was", F.struct(*docs.columns)), ["__was"])
    new = F.when(F.size("spans") > 0, redacted(F.col("__was.text"), F.col("spans"))).otherwise(F.col("__was.text"))
    rows = rows.select("__was", F.size("spans").alias("n"), new.alias("new"))
    out = []
    for c, kind in docs.dtypes:
        was = F.col(f"__was.`{c}`")
        value = F.col("new") if c == "text" else F.when(F.col("n") > 0, F.length("new").cast(kind)).otherwise(was) if c == "n_chars" else was
        out.append(value.alias(c))
    return docs.filter(~may).unionByName(rows.select(*out))
