"""Personal data: base patterns, and boosted trees over overlapping candidates, with DataFrame functions alone.

The base patterns are matched leftmost and without overlap for each kind, and their spans stay. Besides them, high-recall
generators propose spans: cards, phone numbers and addresses as every window of whole digit groups, e-mail addresses also
with (at) and [dot]. Boosted trees of depth two, on features of format (digits, groups, signs, check digit, octets) and
context (what stands beside a span, a cue word before it, whether digit groups go on), score them. Candidates over their
kind's threshold that touch no base span are added; of those that overlap, the best first.

No table labels personal data. The trees learn from EXAMPLES made sentences, with personal data in many forms (spaced, in
brackets, without plus, spelled out) and numbers that are none (dates, prices, versions, ids, tables), with and without cue
words; a candidate is positive if it is a made span, else negative. About FIT_TEXTS texts of the corpus add what is common
there: base spans are positive, candidates beside them and without a cue word are negative. A third of either is held out of
the trees, and gives the thresholds: the least score from which on PRECISION of the candidates is right.

Everything is searched whole, within its row and without any exchange, in time near to linear: sums and bounds up to a place
are taken over pieces of PIECE entries, and spans are compared in the order of their places.

Places are code points. Null and empty texts have no spans; nested or repeated spans of different kinds are each kept
(``redact`` replaces their union once); candidates with equal scores go by length, then by place; repeated rows are searched
each; an empty table gives no row, and fits no tree; further columns are ignored."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, documents, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a match is only tried where one can begin, and long runs need no deep stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
}
#: Kinds proposed as windows of digit groups: the stretch that the groups stand in, the least and most digits, the most groups,
#: and a cheap condition without which a text has no window.
WINDOWS = {
    "ip": (r"[0-9][0-9.]*+", 4, 12, 4, r"[0-9]\.[0-9]"),
    "card": (r"[0-9][0-9\x20-]*+", 13, 19, 19, r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"[+(]?[0-9][0-9\x20().-]*+", 8, 15, 15, r"[0-9](?:[\x20().-]*+[0-9]){7}"),
}
#: Words that announce a kind, looked for in the BEFORE characters before a span.
CUES = {"email": "(?i)mail|contact|kontakt|write to|schreib|correo|courriel", "ip": r"(?i)\bip\b|host|server|address|adress", "card": "(?i)card|visa|karte|tarjeta|carte|paid with", "phone": "(?i)tel|phone|fon|call|mobil|fax|ruf|llam|appel"}
BEFORE = 24
EXAMPLES, FIT_TEXTS, TREES, RATE, PRECISION = 6_000, 20_000, 30, 0.3, 0.95
FEATURES = ("digits", "length", "plus", "paren", "dots", "gaps", "luhn", "octets", "at", "before", "after", "groups", "lead", "tail", "cue", "zero", "longest")
PIECE, DIGITS = 64, "0123456789"

_SPAN = "struct<start:int,end:int,s:string,gap:string,next:string,seen:int>"


def _may(text: Column, kind: str) -> Column:
    """Cheap conditions without which no pattern of the kind matches."""
    if kind == "email":
        return text.contains("@") | text.contains("(at") | text.contains("[at")
    return text.contains("+") | text.rlike("[0-9]{4}") if kind == "phone" else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9]{2}|[0-9][\x20-][0-9]")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def prefixes(values: Column, zero: int, op: Callable) -> Column:
    """op over all values before each one. Those of a piece are gone through, and the pieces before it as one value each."""
    fold = lambda some: F.aggregate(some, F.lit(zero), op)

    def of(v: Column) -> Column:
        count = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int"))
        whole = F.transform(count, lambda c: fold(F.slice(v, c * PIECE + 1, F.lit(PIECE))))
        below = lambda w: F.transform(w, lambda _, c: fold(F.slice(w, F.lit(1), c)))

        def each(base: Column) -> Column:
            return F.transform(v, lambda _, i: op(F.get(base, F.floor(i / PIECE).cast("int")), fold(F.slice(v, i - i % PIECE + 1, i % PIECE))))

        return _let(_let(whole, below), each)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(values, of))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def matches(text: Column, pattern: str, may: Column) -> Column:
    """All matches with their places, the end of what stands before them and the sign after them; seen: characters of all
    matches up to this one. What stands between them gives where they begin."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), F.split(text, pattern, -1).alias("gap"))

    def placed(x: Column) -> Column:
        n = F.size(x["s"])
        pairs = F.zip_with(F.slice(x["gap"], F.lit(1), n), x["s"], lambda g, m: F.struct(g.alias("gap"), m.alias("s")))
        rows = F.zip_with(pairs, F.slice(x["gap"], F.lit(2), n), lambda r, g: F.struct(F.length(r["gap"]).alias("lead"), F.length(r["s"]).alias("size"), F.substring(r["gap"], -BEFORE, BEFORE).alias("gap"), r["s"].alias("s"), F.substring(g, 1, 1).alias("next")))

        def counted(r: Column) -> Column:
            before, seen = (prefixes(F.transform(r, f), 0, _plus) for f in (lambda y: y["lead"] + y["size"], lambda y: y["size"]))
            ends = F.zip_with(before, seen, lambda u, v: F.struct(u.alias("before"), v.alias("seen")))

            def span(y: Column, k: Column) -> Column:
                begin = k["before"] + y["lead"]
                return F.struct(begin.alias("start"), (begin + y["size"]).alias("end"), y["s"].alias("s"), y["gap"].alias("gap"), y["next"].alias("next"), (k["seen"] + y["size"]).alias("seen"))

            return F.zip_with(r, ends, span)

        return _let(rows, counted)

    return F.when(may, _let(both, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _count(s: Column, signs: str) -> Column:
    """How many of these signs a text has."""
    return F.length(s) - F.length(F.translate(s, signs, ""))


def _luhn(s: Column) -> Column:
    """Whether the digits' check sum is right: every second digit from the right counts twice, less nine above nine."""
    each = F.split(F.reverse(F.regexp_replace(s, "[^0-9]", "")), "")
    value = F.transform(each, lambda x, i: F.when(x == "", 0).otherwise(F.ascii(F.when(i % 2 == 0, x).otherwise(F.translate(x, "0123456789", "0246813579"))) - 48))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(s: Column) -> Column:
    return ~F.exists(F.split(s, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) > 3) | (F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int"), F.lit(999)) > 255))


def _valid(kind: str, s: Column) -> Column:
    n = _count(s, DIGITS)
    return {"email": F.lit(True), "ip": _octets(s), "card": n.between(16, 19) & _luhn(s), "phone": n.between(8, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], _may(text, kind)), lambda x: _valid(kind, x["s"]))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)


def windows(text: Column, kind: str) -> Column:
    """Every run of whole digit groups with the kind's number of digits, whatever else it overlaps."""
    stretch, least, most, groups, may = WINDOWS[kind]

    def fits(x: Column) -> Column:
        if kind == "phone":
            return F.lit(True)
        single = F.length(x["s"]) - x["digits"] == x["groups"] - 1  # one sign between two groups
        return single & (~x["s"].rlike("[0-9]{4}") & (x["groups"] == groups)) if kind == "ip" else single

    def within(x: Column) -> Column:
        def of(g: Column) -> Column:
            n = F.size(g)

            def begin(one: Column, i: Column) -> Column:
                sign = F.when((i == 0) & x["s"].rlike("^[+(]"), F.substring(x["s"], 1, 1)).otherwise("")

                def digits(j: Column) -> Column:
                    return F.get(g, j)["seen"] - one["seen"] + F.length(one["s"])

                def window(j: Column) -> Column:
                    more = F.array_join(F.transform(F.slice(g, i + 2, j - i), lambda y: F.concat(y["gap"], y["s"])), "")
                    return F.struct(
                        (x["start"] + one["start"] - F.length(sign)).alias("start"), (x["start"] + F.get(g, j)["end"]).alias("end"), F.concat(sign, one["s"], more).alias("s"),
                        F.when(i == 0, x["gap"]).otherwise(one["gap"]).alias("gap"), F.when(j == n - 1, x["next"]).otherwise(F.substring(F.get(g, j + 1)["gap"], 1, 1)).alias("next"),
                        digits(j).alias("digits"), (j - i + 1).alias("groups"), (i > 0).cast("int").alias("lead"), (j < n - 1).cast("int").alias("tail"),
                    )

                ends = F.filter(F.sequence(i, F.least(i + groups - 1, n - 1)), lambda j: digits(j).between(least, most))
                return F.filter(F.transform(ends, window), fits)

            return F.flatten(F.transform(g, begin))

        return _let(matches(x["s"], "[0-9]++", F.lit(True)), of)

    long = F.filter(matches(text, stretch, text.rlike(may)), lambda x: _count(x["s"], DIGITS) >= least)
    return F.flatten(F.transform(long, within))


def candidates(text: Column, kind: str) -> Column:
    """Proposed spans with their features."""

    def described(x: Column) -> Column:
        s, windowed = x["s"], kind in WINDOWS
        values = {
            "digits": F.least(x["digits"] if windowed else _count(s, DIGITS), F.lit(20)), "length": F.least(F.length(s), F.lit(60)), "plus": F.startswith(s, F.lit("+")).cast("int"), "paren": F.contains(s, F.lit("(")).cast("int"),
            "dots": F.least(_count(s, "."), F.lit(9)), "gaps": F.least(_count(s, " -"), F.lit(9)), "luhn": _luhn(s).cast("int") if kind == "card" else F.lit(0), "octets": _octets(s).cast("int") if kind == "ip" else F.lit(0), "at": F.contains(s, F.lit("@")).cast("int"),
            "before": _side(F.substring(x["gap"], -1, 1)), "after": _side(x["next"]), "groups": x["groups"] if windowed else F.lit(1), "lead": x["lead"] if windowed else F.lit(0), "tail": x["tail"] if windowed else F.lit(0),
            "cue": x["gap"].rlike(CUES[kind]).cast("int"), "zero": s.rlike(r"^\(?0").cast("int"),
            "longest": F.least(F.coalesce(F.array_max(F.transform(F.split(s, "[^0-9]+"), lambda y: F.length(y))), F.lit(0)), F.lit(9)) if windowed else s.rlike("[A-Za-z]{2,}$").cast("int"),
        }
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(*(values[f] for f in FEATURES)).alias("f"))

    return F.transform(windows(text, kind) if kind in WINDOWS else matches(text, WIDE[kind], _may(text, kind)), described)


FREE, TOUCHES, EQUAL = 0, 1, 2
_FAR = (1 << 31) - 1


def nearness(spans: Column, others: Column) -> Column:
    """For each span in order: EQUAL to one of the others, TOUCHES one, or FREE; others that are equal to a span overlap no
    others. What began before it and what begins after it tell by their last end and first start."""
    mark = lambda x, own, i: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), i.alias("i"))
    marks = F.array_sort(F.concat(F.transform(others, lambda x: mark(x, 0, F.lit(-1))), F.transform(spans, lambda x, i: mark(x, 1, i))))

    def swept(m: Column) -> Column:
        other = lambda field, none: F.transform(m, lambda x: F.when(x["own"] == 0, x[field]).otherwise(none))
        ends, starts = prefixes(other("end", -1), -1, _larger), prefixes(other("start", -1), -1, _larger)
        after = F.reverse(prefixes(F.reverse(other("start", _FAR)), _FAR, _smaller))
        both = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        near = F.zip_with(m, both, lambda x, o: F.struct(x["i"].alias("i"), x["end"].alias("end"), F.when((x["start"] == o["start"]) & (x["end"] == o["end"]), EQUAL).when(x["start"] < o["end"], TOUCHES).otherwise(FREE).alias("near")))
        near = F.zip_with(near, after, lambda x, s: F.struct(x["i"].alias("i"), F.when((x["near"] == FREE) & (x["end"] > s), TOUCHES).otherwise(x["near"]).alias("near")))
        return F.transform(F.array_sort(F.filter(near, lambda x: x["i"] >= 0)), lambda x: x["near"])

    return _let(marks, swept)


def grouped(spans: Column) -> Column:
    """Spans in order of their starts, as arrays of those that overlap, or hang together by overlaps."""

    def of(s: Column) -> Column:
        ends = prefixes(F.transform(s, lambda x: x["end"]), -1, _larger)
        new = F.zip_with(ends, F.sequence(F.lit(0), F.size(s) - 1), lambda e, i: F.when(F.get(s, i)["start"] >= e, i))

        def cut(at: Column) -> Column:
            return F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a))

        return _let(F.filter(new, lambda x: x.isNotNull()), cut)

    return _let(spans, of)


class Trees:
    """Boosted trees of depth two on integer features: (feature, cut, left pair, right pair) with pairs (feature, cut, value, value)."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = TREES, rate: float = RATE):
        total = pos + neg
        self.bias = float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
        f = np.full(len(x), self.bias)
        self.trees = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = pos - total * p, total * p * (1 - p)
            on = np.ones(len(x), bool)
            a, cut = self._split(x, g, h, on)
            left = on & (x[:, a] <= cut)
            tree = [a, cut]
            for side in (left, on & ~left):
                b, c = self._split(x, g, h, side)
                low, high = side & (x[:, b] <= c), side & (x[:, b] > c)
                u, v = (rate * float(g[m].sum() / (h[m].sum() + 1)) for m in (low, high))
                f[low] += u
                f[high] += v
                tree.append((b, c, u, v))
            self.trees.append(tree)
        self.fitted = 1 / (1 + np.exp(-f))

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, on: np.ndarray) -> tuple[int, int]:
        best = (-1.0, 0, 0)
        for a in range(x.shape[1]):
            for cut in np.unique(x[on, a])[:-1]:
                m = on & (x[:, a] <= cut)
                r = on & ~m
                gain = g[m].sum() ** 2 / (h[m].sum() + 1) + g[r].sum() ** 2 / (h[r].sum() + 1)
                if gain > best[0]:
                    best = (float(gain), a, int(cut))
        return best[1], best[2]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The scores of feature rows."""
        f = np.full(len(x), self.bias)
        for a, cut, left, right in self.trees:
            for side, (b, c, u, v) in ((x[:, a] <= cut, left), (x[:, a] > cut, right)):
                f += side * np.where(x[:, b] <= c, u, v)
        return 1 / (1 + np.exp(-f))

    def column(self, f: Column) -> Column:
        """The score of an array of features: the trees are data to one expression."""
        node = "struct<a:int,cut:int,b:int,c:int,u:double,v:double,d:int,e:int,x:double,y:double>"
        rows = F.from_json(F.lit(json.dumps([dict(zip("a cut b c u v d e x y".split(), (a, cut, *left, *right))) for a, cut, left, right in self.trees])), f"array<{node}>")

        def add(total: Column, t: Column) -> Column:
            low = F.when(F.get(f, t["b"]) <= t["c"], t["u"]).otherwise(t["v"])
            high = F.when(F.get(f, t["d"]) <= t["e"], t["x"]).otherwise(t["y"])
            return total + F.when(F.get(f, t["a"]) <= t["cut"], low).otherwise(high)

        return 1 / (1 + F.exp(-F.aggregate(rows, F.lit(self.bias), add)))


def _touches(x: Column, others: Column) -> Column:
    return F.exists(others, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made sentences with the spans (kind, start, end) of their personal data."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((12, 14, 14, 14, 15, 17)))
        for last in "0123456789":
            if sum(sum(divmod(int(d) * (1 + (k % 2)), 10)) for k, d in enumerate(reversed(body + last))) % 10 == 0:
                body += last
                break
        cuts = {13: (4, 4, 5), 14: (4, 6, 4), 15: (4, 6, 5), 16: (4, 4, 4, 4)}.get(len(body), (len(body),))
        parts, at = [], 0
        for c in cuts if rng.random() < 0.7 else (len(body),):
            parts.append(body[at : at + c])
            at += c
        return rng.choice(" -").join(parts)

    def phone() -> str:
        return rng.choice((f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", "0" + digits(1) + "".join(" " + digits(2) for _ in range(4)), f"0{digits(3)} {digits(7)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))

    def email() -> str:
        at, dot = rng.choice((("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", ".")))
        return f"{word()}{rng.choice(('', '.' + word(), digits(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'de', 'net', 'fr'))}"

    octet = lambda: str(rng.randint(0, 255))
    made = {"email": email, "ip": lambda: ".".join((str(rng.randint(1, 255)), octet(), octet(), octet())), "card": card, "phone": phone}
    cue = {"email": ("mail ", "contact: "), "ip": ("server ", "host ", "IP "), "card": ("card ", "visa: "), "phone": ("tel. ", "call ", "phone: ", "fax ")}
    none = (
        lambda: f"{rng.randint(1950, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1950, 2040)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1, 9)}.{digits(3)}.{digits(3)}", lambda: f"{rng.randint(1, 99)} {digits(3)} {digits(3)}", lambda: f"3.{digits(rng.randint(7, 11))}", lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: digits(rng.randint(6, 19)),
        lambda: " ".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(3, 12))), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{rng.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(3)}", lambda: ".".join(digits(1) for _ in range(rng.randint(4, 7))),
        lambda: f"{digits(2)}@{digits(1)}.{digits(2)}", lambda: f"#{digits(4)}-{digits(4)}-{digits(4)}", lambda: rng.choice(" -").join(digits(4) for _ in range(rng.randint(3, 6))),
    )
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 2)):
            text += " "
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                text += rng.choice(cue[kind]) if rng.random() < 0.5 else ""
                text += digits(4) + " " if rng.random() < (0.3 if kind == "card" else 0.1) else ""
                x = made[kind]()
                spans.append((kind, len(text), len(text) + len(x)))
                text += x
            else:
                text += rng.choice(none)()
            text += rng.choice(("", ".", ",", " " + word(), " " + word(), " " + word()))
        out.append((text, spans))
    return out


def fit(docs: DataFrame, texts: int = FIT_TEXTS, precision: float = PRECISION, made: int = EXAMPLES) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind, from ``made`` sentences and about ``texts`` texts with an @ or a digit; none where no text has any."""
    text = text_of()
    has = _may(text, "email") | text.rlike("[0-9]")
    n = docs.where(has).count()
    if not n:
        return {}
    # The sample is written once, as each kind below reads it again; its hash is tried before the texts are.
    chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1e6 * texts / n).where(has)
    sample = written(chosen, "op9-sample").select(text.alias("text"), F.lit(False).alias("made"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("true"))
    sentences = docs.sparkSession.createDataFrame([(t, True, x) for t, x in examples(made)], "text string, made boolean, true array<struct<kind:string,start:int,end:int>>")
    rows = sentences.unionByName(sample).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(3)) == 0)
    each = None
    for k in KINDS:
        right = F.when(F.col("made"), F.transform(_of_kind(F.col("true"), k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        right = right.otherwise(F.transform(base_spans(F.col("text"), k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        c = rows.withColumn("c", candidates(F.col("text"), k)).withColumn("right", right).where(F.size("c") > 0)
        c = c.select("made", "held", F.explode(F.zip_with("c", nearness(F.col("c"), F.col("right")), lambda x, near: F.struct(x.alias("c"), near.alias("near")))).alias("x"))
        pos = F.col("x.near") == EQUAL
        neg = F.when(F.col("made"), ~pos).otherwise((F.col("x.near") == FREE) & (F.col("x.c.f")[FEATURES.index("cue")] == 0))
        own = c.select(F.lit(k).alias("kind"), "held", F.col("x.c.f").alias("f"), pos.alias("pos"), neg.alias("neg"))
        each = own if each is None else each.union(own)
    counts = each.groupBy("kind", "held", "f").agg(F.sum(F.col("pos").cast("int")).alias("pos"), F.sum(F.col("neg").cast("int")).alias("neg")).collect()
    out = {}
    for k in KINDS:
        grown, kept = ([r for r in counts if r.kind == k and r.held == h and r.pos + r.neg] for h in (False, True))
        if not kept or not sum(r.pos for r in grown):
            continue
        table = lambda some: (np.array([r.f for r in some]), *(np.array([r[x] for r in some], float) for x in ("pos", "neg")))
        trees = Trees(*table(grown))
        x, pos, neg = table(kept)
        score = trees.of(x)
        order = np.argsort(-score)
        ends = np.flatnonzero(np.append(np.diff(score[order]) != 0, True))  # equal scores go together
        share = (np.cumsum(pos[order]) / np.cumsum((pos + neg)[order]))[ends]
        good = np.flatnonzero(share >= precision)
        if len(good):
            out[k] = (trees, max(0.5, float(score[order[ends[good[-1]]]])))
    return out


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _best(group: Column) -> Column:
    """Of overlapping spans (start, end, p) the best, then the best that touches none so far, and so on."""
    ranked = F.array_sort(F.transform(group, lambda x: F.struct((-x["p"]).alias("less"), (x["start"] - x["end"]).alias("shorter"), x["start"].alias("start"), x["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(ranked, none, lambda acc, x: F.when(_touches(x, acc), acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))


def _added(rows: DataFrame, model: dict[str, tuple[Trees, float]]) -> DataFrame:
    """Adds _new_<kind>: what the trees add to base. In steps, as Spark resolves an expression only so deep."""
    text = text_of()

    def scored(k: str) -> Column:
        each = F.transform(f"_new_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), model[k][0].column(x["f"]).alias("p")))
        return F.filter(each, lambda x: x["p"] >= model[k][1])

    def free(k: str) -> Column:
        near = F.zip_with(f"_new_{k}", f"_near_{k}", lambda x, n: F.when(n == FREE, x))
        return F.array_sort(F.filter(near, lambda x: x.isNotNull()))

    rows = rows.withColumns({f"_new_{k}": candidates(text, k) for k in model})
    rows = rows.withColumns({f"_new_{k}": scored(k) for k in model})
    rows = rows.withColumns({f"_near_{k}": F.when(F.size(f"_new_{k}") > 0, nearness(F.col(f"_new_{k}"), F.col("base"))) for k in model})
    rows = rows.withColumns({f"_new_{k}": F.when(F.size(f"_new_{k}") > 0, free(k)) for k in model}).drop(*(f"_near_{k}" for k in model))
    return rows.withColumns({f"_new_{k}": F.when(F.size(f"_new_{k}") > 0, F.flatten(F.transform(grouped(F.col(f"_new_{k}")), _best))) for k in model})


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def found(docs: DataFrame, model: dict[str, tuple[Trees, float]]) -> DataFrame:
    """Adds base and spans: arrays of (kind, start, end), by kind and start; spans has base and what the trees add."""
    names = [f"_kept_{i}" for i in range(len(docs.columns))]
    text = text_of()
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    rows = rows.withColumns({f"_base_{k}": base_spans(text, k) for k in KINDS})
    rows = rows.withColumn("base", F.concat(*(_named(k, F.col(f"_base_{k}")) for k in KINDS)))
    if model:
        rows = _added(rows, model)
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = [_named(k, F.col(f"_base_{k}")) if k not in model else F.array_sort(F.concat(_named(k, F.col(f"_base_{k}")), _named(k, F.coalesce(f"_new_{k}", none)))) for k in KINDS]
    return rows.select(*(F.col(x).alias(c) for x, c in zip(names, docs.columns) if c not in ("base", "spans")), "base", F.concat(*whole).alias("spans"))


def redact(docs: DataFrame, model: dict[str, tuple[Trees, float]]) -> DataFrame:
    """The rows, with all their columns, with each stretch of spans in the text replaced by the first one's kind in brackets."""
    own, back = aside(docs, ("text",))
    rows = found(own, model)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))))
    text = F.col("text")
    ordered = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (-x["less"]).alias("end"), x["kind"].alias("kind")))
    cuts = F.transform(grouped(ordered), lambda g: F.struct(g[0]["start"].alias("start"), F.array_max(F.transform(g, lambda x: x["end"])).alias("end"), g[0]["kind"].alias("kind")))

    def parts(all_: Column) -> Column:
        """Some cuts at a time take their stretch of the text, and each its own from that: a long text is gone through once
        for PIECE cuts."""

        def some(c: Column) -> Column:
            own, begin = F.slice(all_, c * PIECE + 1, F.lit(PIECE)), F.when(c == 0, 0).otherwise(F.get(all_, c * PIECE - 1)["end"])
            end = F.coalesce(F.get(all_, c * PIECE + PIECE - 1)["end"], F.length(text))

            def inner(piece: Column) -> Column:
                def each(x: Column, i: Column) -> Column:
                    at = F.when(i == 0, begin).otherwise(F.get(own, i - 1)["end"])
                    return F.concat(F.substring(piece, at - begin + 1, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))

                rest = F.element_at(own, -1)["end"]
                return F.concat(F.array_join(F.transform(own, each), ""), F.substring(piece, rest - begin + 1, F.greatest(end - rest, F.lit(0))))

            return _let(F.substring(text, begin + 1, end - begin), inner)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), some), "")

    return back(rows.withColumn("text", F.when(F.size("spans") > 0, _let(cuts, parts)).otherwise(text)))


def _written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = found(docs, fit(docs))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"), _written_out(F.col("spans")).alias("spans"))
