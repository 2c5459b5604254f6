"""Problem 3: personal data in free text, by a semi-Markov conditional random field.

A text's segmentation is scored as a whole: the score of a segment is a weighted sum of features of the whole span (its
shape, length, words inside, words around), segments don't overlap, and tokens outside of segments score nothing. The
best segmentation is found by dynamic programming over segment ends, where boundaries and types are chosen jointly and a
segment is no longer than its type allows; in training, the same lattice gives the partition function and expectations.

A span is a possible segment of a type only if it has the type's outline (an address begins with a number, an e-mail has
an at sign, ...); texts are read whole, and where no span has an outline there is nothing to score.
"""

from __future__ import annotations

import json
import math
import os
import pkgutil
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .common import TOKENIZER_DIR

TYPES = ("email", "phone", "id_number", "address", "name")

_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-ɏ]+(?:[A-ZÀ-ÖØ-Þ][a-zß-ɏ]+)?(?:['’-][A-ZÀ-ÖØ-Þ]?[a-zß-ɏ]+)*|[A-ZÀ-ÖØ-Þ]['’][A-ZÀ-ÖØ-Þ][a-z]+|[A-ZÀ-ÖØ-Þ]{2,}(?:['’-][A-ZÀ-ÖØ-Þ]+)*|[A-ZÀ-ÖØ-Þ]\.|[A-ZÀ-ÖØ-Þ](?![A-Za-z]))"
_PARTICLE = r"(?:van|von|de|der|den|del|la|le|di|da|dos|bin|al|el|ter|zu)"
#: Particles of family names and generational endings that may stand within or after a name (fixed values).
_NAME_RUN = re.compile(rf"(?<![\w@.#+/-]){_CAP}(?:(?:,? |-){_CAP}|(?: {_PARTICLE}){{1,2}} {_CAP})*(?![\w@])")
#: An e-mail address grows from its sign: to the left over the characters of a user, to the right over a host.
_SIGN = re.compile(r"@|[\[({] ?[aA][tT] ?[\])}]| [aA][tT] ")
_HOST = re.compile(r"[\w-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[\w-]+)+", re.I)
_USER = frozenset(".+%-_")
_NUMBER = re.compile(r"(?<![\w/-])(?<!\d[.,])[(+]?\d[\d().\-/ +]{3,}\d(?![\w])|(?<=[A-Za-z][.-])\d[\d().\-/ +]{3,}\d(?![\w])|(?<=[A-Z])\d{5,}(?![\w])")
#: Longest segments of the lattice. What is longer comes out as several adjoining segments, so that none of it is left.
NAME_PARTS, ADDRESS_WORDS, NUMBER_DIGITS = 6, 4, 16
_STREET = (
    "street st road rd lane ln avenue ave drive dr close court ct crescent cres terrace ter boulevard blvd way place pl square sq "
    "row walk grove hill gardens gdns park parkway pkwy mews circle cir highway hwy alley quay green rise view"
).split()  # kinds of streets (fixed values)
_ADDRESS = re.compile(r"(?<![\w.,/#-])\d{1,5}[A-Za-z]? (?:(?:[\w'’-]+|[A-Za-z]{1,3}\.) ){1,%d}?(?:" % ADDRESS_WORDS + "|".join(_STREET) + r")\b", re.I)
_STREET_MORE = re.compile(r" (?:" + "|".join(_STREET) + r")\b", re.I)
_DIGITS = re.compile(r"\d+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_BEFORE = re.compile(rf"(?<!\w)(?:{_PARTICLE} ){{1,2}}$")
_PARTICLES = frozenset("van von de der den del la le di da dos bin al el ter zu".split())
_MORE_DIGITS = re.compile(r"[().\-/ +]{1,3}\d")
_PLACE = re.compile(r"[A-Za-z]? ")
_LEAD = re.compile(r"(?<![\w.,/-])(?:[A-Z]{1,3}[-. ]?|[(+])$")
_GAP = re.compile(r"(?:\. ?|  | )(?=[(+]?\d)")
_ID = re.compile(r"(?:[A-Z]{1,3}(?:-\d{3,}){1,4}(?:-[A-Z]{1,3})?|[A-Z]{1,3}\d{5,}[A-Z]?|\d{5,}[A-Z]?|[A-Z]{2}(?:[ -]?\d{2}){3}[ -]?[A-D])(?!\w)")
_NAME_PART = re.compile(rf"{_CAP}|{_PARTICLE}(?= )")
_TITLES = "Mr Mrs Ms Miss Mx Dr Prof Nurse Sister Doctor Professor Sir Dame Rev".split()  # fixed values
_TITLED = re.compile(rf"(?:^|\W)(?:{'|'.join(_TITLES)})\.? $")
_TRIGGER = re.compile(r"[@\d]|(?: at )|[A-Z]")
#: Characters after a span that its features may see.
AHEAD = 28
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SENTENCE_END = re.compile(r"[.!?:;\n]\W*$|^\W*$|[.,:;] ?\d+\.\s*$|[A-Z]{4}:?\s\s+$")


@lru_cache(maxsize=2)
def common_words(tokenizer_dir: str) -> frozenset:
    """Words of a public tokenizer's vocabulary that are whole with a leading space in lower case: ordinary words."""
    with open(os.path.join(tokenizer_dir, "byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(k[1:] for k in vocab if len(k) > 2 and k[0] == "Ġ" and k[1:].isalpha() and k[1:].islower())


def _outline(x: str) -> str:
    """Digits as 9, letters as A and a, runs of four and more shortened."""
    x = re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", x)))
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", x)


def _long_run(text: str, begin: int, end: int, out: set) -> None:
    """Spans of a run of more digits than a number has: every stretch between blanks with as many digits as a number."""
    parts = [(begin + m.start(), begin + m.end(), sum(map(str.isdigit, m.group()))) for m in re.finditer(r"[^ ]+", text[begin:end])]
    for i in range(len(parts)):
        digits = 0
        for j in range(i, len(parts)):
            digits += parts[j][2]
            if j > i and digits > NUMBER_DIGITS:
                break
            if digits >= 7:
                out.add((parts[i][0], parts[j][1], "phone"))
            if digits >= 5:
                out.add((parts[i][0], parts[j][1], "id_number"))


def _numbers(text: str, out: set) -> None:
    """Spans around runs of digits: phones, identity numbers and addresses."""
    past = -1  # end of the last number looked at
    for m in _DIGITS.finditer(text):
        b, e = m.span()
        if e - b < 6 and _PLACE.match(text, e) and (a := _ADDRESS.match(text, b)):
            end = a.end()
            out.add((b, end, "address"))
            while n := _STREET_MORE.match(text, end):
                end = n.end()
                out.add((b, end, "address"))
        if b < past or e - b < 5 and not _MORE_DIGITS.match(text, e):
            continue
        lead = _LEAD.search(text, max(0, b - 6), b)
        begin = lead.start() if lead else b
        if i := _ID.match(text, begin):
            out.add((begin, i.end(), "id_number"))
        number = _NUMBER.match(text, b - (text[b - 1 : b] in ("(", "+")))
        if not number:
            continue
        begin, past = number.span()
        x = number.group()
        digits = sum(map(str.isdigit, x))
        if digits < 5:
            past = -1 if " " in x else past
            continue
        front = lead.start() if lead and text[lead.start()].isalpha() and " " not in lead.group() else begin
        if digits > NUMBER_DIGITS:
            _long_run(text, begin, past, out)
            continue
        if digits < 7:
            out.add((front, past, "id_number"))
            continue
        if front == begin:
            out.add((begin, past, "phone"))
        out.add((front, past, "id_number"))
        for gap in _GAP.finditer(x):  # a number of a list or sentence may stick to it
            head, rest = x[: gap.start()], x[gap.end() :]
            if sum(map(str.isdigit, rest)) >= 7:
                out.add((begin + gap.end(), past, "phone"))
                out.add((begin + gap.end(), past, "id_number"))
            if sum(map(str.isdigit, head)) >= 7:
                out.add((begin, begin + gap.start(), "phone"))
                out.add((front, begin + gap.start(), "id_number"))


def _emails(text: str, out: set) -> None:
    for m in _SIGN.finditer(text):
        end = m.start()
        spelt = m.group()[0] == " "
        end -= not spelt and text[end - 1 : end] == " "
        b = end
        while b and (text[b - 1].isalnum() or text[b - 1] in _USER):
            b -= 1
        after = m.end() + (not spelt and text[m.end() : m.end() + 1] == " ")
        if b < end and (host := _HOST.match(text, after)):
            out.add((b, host.end(), "email"))


def _names(text: str, out: set) -> None:
    past = -1
    for c in _CAPITAL.finditer(text):
        at = c.start()
        if at < past or not (m := _NAME_RUN.match(text, at)):
            continue
        past = m.end()
        whole = m.group()
        if whole.isalpha():
            parts = [(at, past)]
        else:
            parts = [p.span() for p in _NAME_PART.finditer(text, at, past)]
        if at > 2 and text[at - 1] == " " and text[text.rfind(" ", 0, at - 1) + 1 : at - 1] in _PARTICLES and (
            particle := _BEFORE.search(text[max(0, at - 8) : at])
        ):
            b = at - len(particle.group())
            out.update((b, e, "name") for _, e in parts[:3] if not text[e - 1].islower() or text[e - 2 : e].isalpha())
        for i in range(len(parts)):
            if text[parts[i][0] : parts[i][1]].rstrip(".") in _TITLES:
                continue
            for j in range(i, min(i + NAME_PARTS, len(parts))):
                last = text[parts[j][0] : parts[j][1]]
                if last[0].islower() or (i == j and len(last) <= 2):
                    continue
                if j > i + 1 and text.count(",", parts[i][0], parts[j][1]) > 1:
                    continue
                end = parts[j][1]
                if last[-1] == "." and j + 1 == len(parts):  # a full stop after a last initial may end the sentence
                    out.add((parts[i][0], end - 1, "name"))
                out.add((parts[i][0], end, "name"))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, type) of every span with the outline of a type, sorted by end. Texts are read whole, without windows."""
    out: set = set()
    _emails(text, out)
    _numbers(text, out)
    _names(text, out)
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def starts_sentence(text: str, at: int) -> bool:
    """Whether a sentence, list item or line begins here; the full stop of a title ends none."""
    left = text[max(0, at - 12) : at]
    return _SENTENCE_END.search(left) is not None and _TITLED.search(left) is None


def features(text: str, b: int, e: int, kind: str, words: frozenset) -> list[str]:
    """Features of the whole span text[b:e] as a segment of a type; each type has weights of its own for them."""
    x = text[b:e]
    initial = starts_sentence(text, b)
    before = ["^"] if initial and kind == "name" else _WORDS.findall(text[max(0, b - 48) : b])[-4:]
    after = _WORDS.findall(text[e : e + AHEAD])[:2]
    low_b, low_a = [w.lower() for w in before], [w.lower() for w in after]
    p1, p2, p3 = (["^"] * 3 + low_b)[-1], (["^"] * 3 + low_b)[-2], (["^"] * 3 + low_b)[-3]
    n1, n2 = (low_a + ["$"] * 3)[0], (low_a + ["$"] * 3)[1]
    out = ["bias", f"p1={p1}", f"p2={p2}", f"p3={p3}", f"p12={p2} {p1}", f"n1={n1}", f"n2={n2}", f"n12={n1} {n2}", f"pn={p1}|{n1}"]
    if kind in ("phone", "id_number"):
        digits = sum(c.isdigit() for c in x)
        out += [f"shape={_outline(x)}", f"digits={digits}", f"seps={''.join(sorted(set(c for c in x if not c.isalnum())))}", f"alpha={x[0].isalpha()}"]
        out += [f"w={w}" for w in low_b]
        groups = "-".join(str(len(g)) for g in re.findall(r"\d+", x))
        out += [f"groups={groups}", f"plus={x[0]}" if x[0] in "+(" else "bare"]
    elif kind == "address":
        tokens = re.findall(r"[\w'’.-]+", x)
        low = [t.lower().strip(".") for t in tokens]
        out += [
            f"len={len(tokens)}", f"street={low[-1]}", f"caps={sum(t[0].isupper() or t[0].isdigit() for t in tokens) == len(tokens)}",
            f"ordinary={sum(t in words for t in low[1:-1])}", f"second={low[1] if low[1] in words else '*'}",
            f"nth={bool(re.match(r'[0-9]+(?:st|nd|rd|th)$', low[1]))}"
        ]
        out += ["lower" if x == x.lower() else "upper" if x == x.upper() else "mixed", f"next={'word' if n1 in words else n1 if not n1.isalpha() else 'other'}"]
        more = _STREET_MORE.match(text, e)
        out.append(f"more={bool(more)}")
    elif kind == "name":
        tokens = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", x)
        shape = "".join(
            "i" if len(t) == 1 else (
                "W" if t.lower() in words else "U"
            ) if t.isupper() else "l" if t.islower() else "w" if t.lower() in words else "N" for t in tokens
        )
        comma = "," if "," in x else ""
        adjoining = bool(
            re.match(r"(?: |-)[A-Z]", text[e : e + 2])
        ), not initial and text[b - 1 : b] in (" ", "-") and bool(before) and before[-1][:1].isupper()
        title = not initial and _TITLED.search(text[max(0, b - 12) : b]) is not None
        out += [
            f"tok={shape}{comma}", f"len={len(tokens)}", f"init={initial}", f"title={title}", f"adj={adjoining[0]}{adjoining[1]}",
            f"tok={shape}|init={initial}", f"tok={shape}|n1={n1}", f"init={initial}|n1={n1}", f"tok={shape}|p1={p1}",
            f"tok={shape}|{comma}|title={title}"
        ]
        out += [f"nx={'Cap' if after and after[0][:1].isupper() else 'punct' if n1[:1] in '.,;:()' else 'word'}|init={initial}|tok={shape}"]
        out += [
            f"first={tokens[0].lower()}" if tokens[0].lower() in words else "first*",
            f"last={tokens[-1].lower()}" if tokens[-1].lower() in words else "last*"
        ]
        out += [f"end={t.lower()[-3:]}" for t in tokens if len(t) > 3] + [f"in={t.lower()}" for t in tokens if t.lower() in words]
    else:
        ending = re.split(r"\W+", x)[-1]
        out += [
            "at" if "@" in x else "spelt", f"dots={min(3, x.count('.'))}",
            f"ends={'digit' if ending.isdigit() else 'short' if len(ending) < 2 else 'word'}|{'@' in x}", f"bracket={bool(re.search(r'[(\[{]', x))}",
            f"dot={' dot' in x.lower() or '(dot' in x.lower()}"
        ]
    return out


class Model:
    """Weights of features, by `type|feature`."""

    def __init__(self, weights: dict[str, float], tokenizer_dir: str = TOKENIZER_DIR):
        self.words = common_words(tokenizer_dir)
        self.weights: dict[str, dict[str, float]] = {k: {} for k in TYPES}
        for name, w in weights.items():
            kind, feature = name.split("|", 1)
            self.weights[kind][feature] = w
        self.known: dict = {}

    def score(self, text: str, b: int, e: int, kind: str) -> float:
        """Weights of the features. What a sentence begins with is often the same, and its features see no words before it: remembered."""
        get = self.weights[kind].get
        if kind == "name" and starts_sentence(text, b):
            ahead = text[e : e + AHEAD]
            key = (text[b:e], ahead[:1], *ahead.split(None, 2)[:2])
            s = self.known.get(key)
            if s is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                s = self.known[key] = sum([get(f, 0.0) for f in features(text, b, e, kind, self.words)])
            return s
        return sum([get(f, 0.0) for f in features(text, b, e, kind, self.words)])

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Segments of the best segmentation, in order."""
        if not _TRIGGER.search(text):
            return []
        spans = candidates(text)
        best: list[float] = [0.0]  # best[k]: best score with segments among the first k spans
        back: list[tuple[int, bool]] = [(0, False)]
        ends = [c[1] for c in spans]

        for k, (b, e, kind) in enumerate(spans, 1):
            s = self.score(text, b, e, kind)
            if s > 0:
                j = bisect_right(ends, b, 0, k - 1)
                if best[j] + s > best[k - 1]:
                    best.append(best[j] + s)
                    back.append((j, True))
                    continue
            best.append(best[k - 1])
            back.append((k - 1, False))
        out, k = [], len(spans)
        while k:
            j, taken = back[k]
            if taken:
                out.append(spans[k - 1])
            k = j
        return out[::-1]


def fit(
    labelled: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, tokenizer_dir: str = TOKENIZER_DIR
) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the labelled segmentations, by AdaGrad on the lattice's gradient."""

    words = common_words(tokenizer_dir)
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    lattices = []
    for text, gold in labelled:
        spans = candidates(text)
        ends, begins = [c[1] for c in spans], sorted(range(len(spans)), key=lambda i: spans[i][0])
        lattices.append((spans, [[f"{c[2]}|{f}" for f in features(text, *c, words)] for c in spans], set(gold), ends, begins))
    for epoch in range(epochs):
        for at in range(len(lattices)):
            spans, feats, gold, ends, begins = lattices[(at * 7919 + epoch) % len(lattices)]
            if not spans:
                continue
            n = len(spans)
            s = [min(30.0, max(-30.0, sum(weights.get(f, 0.0) for f in fs))) for fs in feats]
            # alpha[k]: log of the sum over segmentations that use the first k spans (by end); beta likewise by begin
            alpha = [0.0]
            before = []
            for k, (b, e, _) in enumerate(spans):
                j = bisect_right(ends, b)
                before.append(j)
                hi, lo = max(alpha[-1], alpha[j] + s[k]), min(alpha[-1], alpha[j] + s[k])
                alpha.append(hi + math.log1p(math.exp(lo - hi)))
            order = begins
            starts = [spans[i][0] for i in order]
            beta = [0.0] * (n + 1)
            after = [0] * n

            for r in range(n - 1, -1, -1):
                i = order[r]
                j = bisect_left(starts, spans[i][1])
                after[i] = j
                hi, lo = max(beta[r + 1], beta[j] + s[i]), min(beta[r + 1], beta[j] + s[i])
                beta[r] = hi + math.log1p(math.exp(lo - hi))
            for k in range(n):
                expected = math.exp(min(0.0, alpha[before[k]] + s[k] + beta[after[k]] - alpha[n]))
                g = (spans[k] in gold) - expected
                if abs(g) < 1e-3:
                    continue
                for f in feats[k]:
                    w = weights.get(f, 0.0)
                    d = g - l2 * w
                    seen[f] = seen.get(f, 0.0) + d * d
                    weights[f] = w + rate * d / math.sqrt(seen[f] + 1e-6)
    return {f: round(w, 3) for f, w in weights.items() if abs(w) >= 0.02}


@lru_cache(maxsize=2)
def trained(tokenizer_dir: str = TOKENIZER_DIR) -> Model:
    """The model that pii_train.py trains."""
    return Model(json.loads(pkgutil.get_data(__package__, "pii_weights.json")), tokenizer_dir)


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType()),
            T.StructField("pii_text", T.StringType())
        ]
    )
)
_BOTH = T.StructType([T.StructField("found", _FOUND), T.StructField("redacted", T.StringType())])


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder such as [EMAIL] in place of each segment and all else unchanged."""
    out, at = [], 0
    for b, e, kind in found:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact_fields(df: DataFrame, key: str, fields: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """item_key, field_name, found (begin, end, pii_type, pii_text) and redacted, for each row and each of `fields`.

    One Arrow pass over whole texts of all fields, without a shuffle.

    Defined cases. Null text: found and redacted null. Empty text: nothing found. Null key: kept. Repeated rows: each has
    its result. Empty table: empty result. Other columns are not read.
    """

    @F.pandas_udf(_BOTH)
    def run(texts):
        import pandas as pd

        model = trained(tokenizer_dir)
        found = [model.find(t) if isinstance(t, str) else None for t in texts]
        return pd.DataFrame(
            {
                "found": [None if f is None else [(b, e, k, t[b:e]) for b, e, k in f] for f, t in zip(found, texts)],
                "redacted": [None if f is None else redact(t, f) for f, t in zip(found, texts)]
            }
        )

    run = run.asNondeterministic()  # else a filter on the result would run it a second time
    each = spread(df.select(key, *fields)).select(
        F.col(key).cast("string").alias("item_key"), *(run(F.col(f).cast("string")).alias(f"r{i}") for i, f in enumerate(fields))
    )
    rows = each.select(
        "item_key",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(f).alias("field_name"), F.col(f"r{i}.found").alias("found"), F.col(f"r{i}.redacted").alias("redacted")) for i, f in enumerate(fields)
                )
            )
        ).alias("r")
    )
    return rows.select("item_key", "r.field_name", "r.found", "r.redacted")


def personal_data(redacted: DataFrame) -> DataFrame:
    """item_key, field_name, pii_type, pii_text of redact_fields(), distinct."""
    return redacted.where("size(found) > 0").select(
        "item_key", "field_name", F.explode("found").alias("f")
    ).select("item_key", "field_name", "f.pii_type", "f.pii_text").distinct()
