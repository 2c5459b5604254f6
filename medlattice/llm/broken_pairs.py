"""Problem 5: prompt and answer pairs that can't be used, with the kind of their defect.

Each answer is read whole, in this order: nothing in it (empty), only the prompt again (copies_question, by greedy string
tiling), declining (refusal, by a grammar of sentences), another language (script and function words), and stopping
before its end (truncated, by a pushdown parser of fences, brackets, quotations and mark-up, and by how its last words are
used in all answers: words that hardly ever end a sentence don't end an answer). A list of fewer items than were announced
is cut off; where no number was announced, a list is judged by its last line.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .languages import FUNCTION_WORDS, letters, scores, script
from .refusals import is_refusal

#: Share of uses of the last words that end a sentence below which an unpunctuated answer counts as cut off.
END_SHARE = 0.15
#: An answer of one part with at most so many words may be a phrase ("twice a day") instead of a sentence: it is cut off
#: only if sentences of other answers begin with it and go on, or if its last word can't end anything.
PHRASE = 6
#: Tiles of the greedy string tiling must be this long, and cover this share of both texts, for a copy.
TILE, COVER = 2, 0.75

_MARKUP = re.compile(r"<[^<>]*>")
_INVISIBLE = re.compile(r"[​-‏ -‮⁠-⁤﻿­᠎]")
_LABEL = r"(?:answer|antwort|respuesta|réponse|reponse|risposta|resposta|antwoord|ответ|a|r|response|reply|result|output|q|question|final answer|in short|summary)"
#: What stands for an answer that is not there (fixed values).
_FILLER = re.compile(
    r"(?:n\.?/?a\.?|none|null|nil|nan|tbd|tba|tbc|todo|to be (?:added|done|confirmed|determined|completed)|undefined|unknown|empty|blank|missing|no (?:answer|response|reply|data|text|content|output)(?: (?:given|available|provided|found|yet))?"
    r"|not (?:available|applicable|answered|provided|given)|pending|placeholder|lorem ipsum|xxx+|insert answer here|your answer(?: here)?|answer(?: goes)? here|see above|error|test|keine? (?:antwort|angabe)|sin respuesta|sans réponse|aucune réponse|k\.?a\.?|s/r|-+|\?+)", re.I)  # fmt: skip
_LEAD = re.compile(
    r"^\W*(?:(?:you asked|your question|the question (?:is|was)|the question|question|query|asked|prompt|q|you wanted to know|you want to know|frage|pregunta|question posée|sie fragten|vous demandez|usted pregunta)\s*[:\-–—]?\s+)", re.I)
_ANSWER_LEAD = re.compile(rf"^\W*{_LABEL}\s*[:\-–—]\s*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_QUOTE = re.compile(r"[\"“«„]")
_QUOTED = re.compile(r"[\"“«„][^\"”»“]*[\"”»“]")
_RULES = re.compile(r"```\w*|\*+|#+|_{2,}|~~")


#: Characters beyond which no filler goes; each of its words has four on average at least.
_FILLS = 80


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, invisible characters, punctuation, bare mark-up, filler and labels."""
    if answer is None:
        return True
    x = answer
    if "<" in x or "&" in x:
        x = html.unescape(_MARKUP.sub(" ", x))
    if not x.isascii():
        x = _INVISIBLE.sub("", x)
    if len(x) > _FILLS and len(_WORD.findall(x[: 5 * _FILLS])) > _FILLS // 4:  # so many words are no filler, whatever follows
        return False
    x = _RULES.sub(" ", x).strip()
    for _ in range(3):
        if not re.search(r"[^\W_]", x):
            return True
        x = re.sub(r"^[\W_]+|[\W_]+$", "", x)
        if _FILLER.fullmatch(x) or re.fullmatch(_LABEL, x, re.I) and len(x) > 1 or re.fullmatch(r"[aqr]", x, re.I):
            return True
        shorter = re.sub(rf"^{_LABEL}\s*[:\-–—]\s*", "", x, flags=re.I)
        if shorter == x:
            return False
        x = shorter
    return not re.search(r"[^\W_]", x)


def tile(a: list[str], b: list[str], least: int = TILE, again: bool = False) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of unmarked words, longest first, as (place in a, place in b, length).

    again: a may say b any number of times, so words of b are not marked.
    """
    mark_a, mark_b, tiles = [False] * len(a), [False] * len(b), []
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    while True:
        longest, found = least - 1, []
        for i, w in enumerate(a):
            if mark_a[i]:
                continue
            for j in where.get(w, ()):
                if mark_b[j]:
                    continue
                k = 1
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not mark_a[i + k] and not mark_b[j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(i, j)]
                elif k == longest and k >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(mark_a[i : i + longest]) and not any(mark_b[j : j + longest]):
                mark_a[i : i + longest] = [True] * longest
                if not again:
                    mark_b[j : j + longest] = [True] * longest
                tiles.append((i, j, longest))


#: Words that the lead-ins of _ANSWER_LEAD and _LEAD have at most together.
_LEAD_WORDS = 8


def _after(lead: re.Pattern, x: str) -> str:
    m = lead.match(x)
    return x[m.end() :] if m else x


def _words(x: str) -> list[str]:
    return _WORD.findall(x.lower())


def copies(query: str, answer: str) -> bool:
    """Whether the answer has nothing but the query, reworded or framed: tiles of the query cover both, nothing else is told."""
    q, a = _words(query), _words(answer)
    if len(q) < 3 or len(a) < 0.6 * len(q):
        return False
    known = set(q)
    most = max(2, 0.25 * len(q))
    if len([w for w in a if w not in known]) > most + _LEAD_WORDS:
        return False
    a = _words(_after(_LEAD, _after(_ANSWER_LEAD, answer)))
    new = sum(w not in known for w in a)  # no tile covers these
    if new > most:
        return False
    tiles = tile(a, q, again=True)  # the query may be said any number of times
    taken = {i + k for i, _, n in tiles for k in range(n)}
    reached = {j + k for _, j, n in tiles for k in range(n)}
    rest = {w for i, w in enumerate(a) if i not in taken}
    full = len(reached) + sum(j not in reached and w in rest for j, w in enumerate(q))
    return len(a) - new >= COVER * len(a) and full >= COVER * len(q)


def other_language(query: str, answer: str) -> bool:
    """Whether the answer, without lead-ins and quoted words, is in another language than the query.

    Of languages that share their words (Danish and Norwegian, say), the one that fits best need not be the right one, so
    the best language of the answer must stand clear of every language that the query may be in.
    """
    body = _after(_ANSWER_LEAD, _QUOTED.sub(" ", answer) if _QUOTE.search(answer) else answer)
    words = letters(body)
    if sum(map(len, words)) < 8:
        return False
    asked, told = script(query), script(body)
    if told != "latin" or asked not in ("latin", ""):
        return told != asked and bool(told)
    own, _ = scores(letters(query))
    found, hits = scores(words)
    if not found:
        return False
    own = own or {"en": 1.0}
    most = max(own.values())
    best = max(found, key=lambda n: found[n])
    may_be = {n for n, v in own.items() if v >= most - 0.1}
    clear = found[best] - max(found.get(n, 0.0) for n in may_be)
    return best not in may_be and clear > 0.15 and (hits >= 3 or hits >= 2 and len(_words(body)) <= 8)


_CLOSE = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "）": "（", "」": "「"}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_ENDLESS = frozenset("br hr img input meta li p td tr th".split())
_NUMBERS = {w: n for n, w in enumerate("two three four five six seven eight nine ten eleven twelve".split(), 2)}
#: A line that announces so many items, which follow it.
_ANNOUNCED = re.compile(r"\b(\d{1,2}|" + "|".join(_NUMBERS) + r")\b[^.:!?\n]{0,60}:\s*$", re.I)
#: What the parser stops at.
_MARK = re.compile(r"```|[()\[\]{}«»“”（）「」\"`]|<(?=/?[a-zA-Z])")


def list_short(text: str) -> bool:
    """Whether the text ends within a list of which fewer items have come than a line before it announced.

    The parser's stack holds, for each list that is open, its indent, the items announced and the items seen.
    """
    stack: list[list[int]] = []
    announced = 0
    for line in filter(str.strip, text.split("\n")):
        item = _ITEM.match(line)
        indent = len(line) - len(line.lstrip())
        if item:
            while stack and stack[-1][0] > indent:
                stack.pop()
            if not stack or stack[-1][0] < indent or announced:
                stack.append([indent, announced, 0])
            stack[-1][2] += 1
        elif not (stack and indent > stack[-1][0]):  # lines indented further go on with an item
            stack.clear()
        m = _ANNOUNCED.search(line)
        announced = (int(m[1]) if m[1].isdigit() else _NUMBERS[m[1].lower()]) if m else 0
    return any(seen < told for _, told, seen in stack)


def left_open(answer: str) -> bool:
    """A pushdown parser over fences, inline code, brackets, quotations and tags: whether something is never closed."""
    stack: list[str] = []
    lost = False  # a bracket whose outer one was closed first
    at = 0
    while m := _MARK.search(answer, at):
        c, at = m.group(), m.end()
        if stack and stack[-1] == "```" and c != "```":
            continue
        if c in ("```", '"', "`"):
            if c in stack:
                while stack.pop() != c:
                    pass
            else:
                stack.append(c)
        elif c == "<":
            if not (tag := _TAG.match(answer, at - 1)):
                continue
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                if "<" + name in stack:
                    while stack.pop() != "<" + name:
                        pass
            elif not tag[3].endswith("/") and name not in _ENDLESS:
                stack.append("<" + name)
        elif c in _CLOSE:
            if _CLOSE[c] in stack:
                while (top := stack.pop()) != _CLOSE[c]:
                    lost |= top in _CLOSE.values()
        else:
            stack.append(c)
    return lost or bool(stack) or answer.count("**") % 2 == 1


#: Endings of a text that has stopped in mid-sentence, and of one that has not (fixed values).
_CUT_END = re.compile(r"(?:[,;:(\[{/&+=–—-]|…|\.{3,}|[‚„“«]|\b\d+[.)])$")
_WHOLE_END = re.compile(r"(?:[.!?。！？؟।]|\betc)[\"'”’»)\]*_`]*$")
_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•–])\s*(.*)$")


def cut_state(answer: str) -> tuple[bool | None, str]:
    """(truncated, last part): None where it depends on how the last words are used, which are then given."""
    x = (answer if answer.isascii() else _INVISIBLE.sub("", answer)).rstrip()
    if x.endswith(">"):
        x = re.sub(r"(?:</\w+>\s*)+$", "", x).rstrip()
    if left_open(x) or "\n" in x and list_short(x):
        return True, ""
    body = x
    if x.endswith(("]", ")")):
        body = re.sub(r"(?:\s*(?:\[\d+(?:[,–-] ?\d+)*\]|\([^()]{1,60}\)))+$", "", x).rstrip()  # references after the end
    if not body:
        return False, ""
    if _CUT_END.search(body):
        if re.search(r"\d[.)]$", body) and not re.search(r"(?:^|\n)\s*\d+[.)]$", body):
            return False, ""  # a number that ends a sentence
        return True, ""
    if _WHOLE_END.search(body):
        return False, ""
    last = body.split("\n")[-1]
    item = _ITEM.match(last)
    if item and not item[1].strip():
        return True, ""
    part = re.split(r"(?<=[.!?。！？])\s+", item[1] if item else last)[-1]
    return None, part


_NUMERAL = re.compile(r"\d+(?:[.,]\d+)*")
_RUN_WORD = re.compile(r"[^\W_]+(?:[.'’/-][^\W_]+)*%?")
_LINES = re.compile(r"\n+|(?<=[.!?。！？])[\"'”’»)\]]*\s+|(?<=[。！？])")


def _last_words(part: str) -> list[str]:
    """Words in lower case, numbers as 0."""
    return _RUN_WORD.findall(_NUMERAL.sub("0", part.lower()))


def _ends_nothing(word: str, query: str, answer: str) -> bool:
    """Whether a function word of a language that the pair may be in; "no" may end an answer."""
    found, _ = scores(letters(f"{query} {answer}"))
    most = max(found.values(), default=0.0)
    return word != "no" and any(word in FUNCTION_WORDS[n] for n, v in found.items() if v >= most - 0.1)


def judge(query: str | None, answer: str | None) -> tuple[str, str, str, str, str]:
    """(defect or '', last three, two, one words, the whole as a phrase): the words are given where they decide whether the answer is cut off."""
    query = query or ""
    if is_empty(answer):
        return "empty", "", "", "", ""
    if copies(query, answer):
        return "copies_question", "", "", "", ""
    other = other_language(query, answer)
    if not other and is_refusal(answer, query):
        return "refusal", "", "", "", ""
    if other:
        return "other_language", "", "", "", ""
    cut, part = cut_state(answer)
    if cut is not None:
        return "truncated" if cut else "", "", "", "", ""
    w = _last_words(part)
    if not w or len(_last_words(answer)) == 1:  # one word is an answer, not the beginning of one
        return "", "", "", "", ""
    whole = len(w) == len(_last_words(answer))
    phrase = f"^{' '.join(w)}" if len(w) <= PHRASE and whole and not (len(w) > 1 and _ends_nothing(w[-1], query, answer)) else ""
    return "?", " ".join(w[-3:]) if len(w) > 2 else "", " ".join(w[-2:]) if len(w) > 1 else "", w[-1], phrase


def _count_runs(text: str, uses: Counter, ends: Counter) -> None:
    """Count the runs of one to three words, those that a sentence or item ends with, and, marked ^, beginnings of sentences that go on."""
    for line in _LINES.split(text):
        item = _ITEM.match(line)
        part = (item[1] if item else line).strip()
        w = _last_words(part)
        if not w:
            continue
        closed = item is not None or _WHOLE_END.search(part) is not None
        told = w if closed else w[:-1]  # whether an open last word is an end is the question
        uses.update(told)
        uses.update(map(" ".join, zip(told, told[1:])))
        uses.update(map(" ".join, zip(told, told[1:], told[2:])))
        if closed:
            ends.update(" ".join(w[-k:]) for k in range(1, min(3, len(w)) + 1))
        uses.update(f"^{' '.join(w[:k])}" for k in range(1, min(PHRASE + 1, len(w))))


def broken_pairs(pairs: DataFrame, id_col: str, query_col: str, answer_col: str) -> DataFrame:
    """item_id, defect of each defective pair: empty, truncated, refusal, copies_question or other_language; once per id.

    Texts are read whole in one Arrow pass. Only the unpunctuated answers whose last words must decide are joined with
    the counts of those words over all answers; the counts are summed per task before they are shuffled. Copies of a
    pair count once, and a phrase counts by the distinct queries that it answers, so neither makes a cut answer sound.

    Defined cases. Null or blank answer: empty, whatever the query. Null query: taken as blank, its language as English.
    Null id: not used. Repeated ids: judged once per distinct pair, the first defect by name. Empty table: empty result.
    Other columns are not read.
    """
    import pyarrow as pa

    base = spread(
        pairs.select(F.col(id_col).alias("item_id"), F.col(query_col).cast("string").alias("q"), F.col(answer_col).cast("string").alias("a"))
    ).where("item_id is not null")

    def look(batches):
        for b in batches:
            asked = b.column("q").to_pylist()
            rows = [judge(q, a) for q, a in zip(asked, b.column("a").to_pylist())]
            rows = [(*r, r[4] and r[4].rpartition(" ")[0], " ".join(_words(q or "")) if r[4] else "") for q, r in zip(asked, rows)]
            keep = [i for i, r in enumerate(rows) if r[0]]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").take(pa.array(keep, pa.int64())), *(pa.array([rows[i][k] for i in keep], pa.string()) for k in range(7))],
                names=["item_id", "defect", "w3", "w2", "w1", "w0", "ws", "asked"]
            )

    def count(batches):
        ends: Counter = Counter()
        uses: Counter = Counter()

        def flush():
            keys = list(uses)
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([uses[k] for k in keys], pa.int64())],
                names=["run", "ends", "uses"]
            )
            ends.clear()
            uses.clear()
            return out

        for b in batches:
            for a in b.column("a").to_pylist():
                _count_runs(a or "", uses, ends)
            if len(uses) > 300_000:
                yield flush()
        if uses:
            yield flush()

    kind = base.schema["item_id"].dataType.simpleString()
    judged = materialise(
        base.mapInArrow(look, f"item_id {kind}, defect string, w3 string, w2 string, w1 string, w0 string, ws string, asked string"), "pairs-judged"
    )
    asked = judged.where("defect = '?'").select(F.explode(F.array("ws", "w0", "w1", "w2", "w3")).alias("run")).where("run <> ''").distinct()
    told = spread(base.select("q", "a").where("a is not null").distinct())  # else hot copies would decide what is usual
    runs = told.mapInArrow(count, "run string, ends long, uses long").join(asked, "run", "left_semi").groupBy("run").agg(
        F.sum("ends").alias("ends"), F.sum("uses").alias("uses")
    )
    runs = materialise(runs, "pairs-runs")
    open_ = judged.where("defect = '?'")
    recurs = open_.where("w0 <> ''").groupBy("w0").agg(F.countDistinct("asked").alias("queries"))
    open_ = open_.join(recurs, "w0", "left")
    for k in ("3", "2", "1", "0", "s"):
        open_ = open_.join(runs.select(F.col("run").alias(f"w{k}"), F.col("ends").alias(f"e{k}"), F.col("uses").alias(f"u{k}")), f"w{k}", "left")
    # the longest run that is used often enough decides; a last word never seen elsewhere is a fragment
    share = lambda k: F.col(f"e{k}") / F.col(f"u{k}")
    enough = lambda k, n: F.coalesce(F.col(f"u{k}"), F.lit(0)) >= n
    # of the queries answered by the phrase or by a sentence that begins with it (without its last word) and goes on, enough have the phrase
    holds = lambda k: F.col("queries") / (F.col("queries") + F.coalesce(f"u{k}", F.lit(0))) >= END_SHARE
    known = (F.coalesce("u1", F.lit(0)) > 0) | (F.col("queries") > 1) & holds("s")
    phrase = (F.col("w0") != "") & known & ((F.coalesce("u0", F.lit(0)) == 0) | holds("0"))
    cut = F.when(phrase, F.lit(False)).when(
        enough(3, 4), share(3) < END_SHARE
    ).when(enough(2, 4), share(2) < END_SHARE).when(enough(1, 1), share(1) < END_SHARE).otherwise(F.lit(True))
    cut_off = open_.where(cut).select("item_id", F.lit("truncated").alias("defect"))
    return judged.where("defect <> '?'").select("item_id", "defect").unionByName(cut_off).groupBy("item_id").agg(F.min("defect").alias("defect"))
