"""Best containment of sentences in answers, block by block: which sentence's distinct words an answer holds most of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Shares down to which sentences are looked for one after the other; an answer whose best sentence is above a share needs no lower one.
LEVELS = (0.9, 0.8)
#: Distinct words up to which an answer is looked up by pairs of its words; longer ones, whose pairs would be many, by single words.
PAIRED_WORDS = 64
#: Places of the answers' words held at once, and words of candidates compared at once.
MARK_BYTES, COMPARED = 32 << 20, 4 << 20
#: Widths of the tables of words that sentences are laid out in: whole groups of 8, and single words, which no pair can meet.
_WIDTHS = (1, 8, 16, 24, 32, 64)


def _lists(joined: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, flat words) of texts of words that are divided by single blanks."""
    lists = pc.split_pattern(pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.string()), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    return np.concatenate([[0], np.cumsum(sizes)]), pc.list_flatten(lists)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class _Keys:
    """Places by key: for each key its postings, and those of several keys at once."""

    def __init__(self, keys: np.ndarray, of: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.of = of[order]
        self.keys, self.begin, self.size = np.unique(keys[order], return_index=True, return_counts=True)

    def met(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, begin, size) of the postings of those keys that are known."""
        if not len(self.keys):
            return (np.zeros(0, "int64"),) * 3
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, self.begin[at[hit]], self.size[at[hit]]


def _needed(n: np.ndarray, share: float) -> np.ndarray:
    """The fewest of n words that are more than the share."""
    return np.floor(n * share).astype("int64") + 1


class _Sentences:
    """Sentences of up to a width, their words in the order of rarity, and for every level the keys by which they are met."""

    def __init__(self, words: np.ndarray, n: np.ndarray, number: np.ndarray, shares: tuple[float, ...], vocabulary: int):
        self.words, self.n, self.number, self.stride = words, n, number, vocabulary + 1  # words: one row a sentence, filled up with the number after the last
        self.pairs, self.singles = [], []
        done = np.zeros(len(n), "int64")  # heads of the level above, whose keys are taken
        for share in shares:
            head = n - _needed(n, share) + 1  # one of the first `head` words is held, and two of one more
            none, keys, of, ones, ones_of = np.zeros(0, "int64"), [], [], [], []
            for j in range(min(words.shape[1], int(head.max()) + 1)):
                known = words[:, j] < vocabulary
                alone = np.flatnonzero(known & (j < head) & (j >= done))
                ones.append(words[alone, j].astype("int64")), ones_of.append(alone)
                late = np.flatnonzero(known & (j <= head) & ((j > done) | (done == 0)))
                for i in range(j):
                    both = late[words[late, i] < vocabulary]
                    keys.append(words[both, i].astype("int64") * vocabulary + words[both, j]), of.append(both)
            self.pairs.append(_Keys(np.concatenate([none, *keys]), np.concatenate([none, *of])))
            self.singles.append(_Keys(np.concatenate([none, *ones]), np.concatenate([none, *ones_of])))
            done = head


def best_contained(answers: pa.ChunkedArray, sentences: pa.ChunkedArray, order: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(answer, sentence, similarity) by place: of each answer the sentence of which it holds the largest share of words, above `share`.

    Both are distinct words divided by blanks; ties go to the smaller order, and all of one order are given. A sentence of n
    words of which more than the share is held has one of its n - floor(share n) rarest words in the answer, and two of one
    more than these, so that no contained sentence is missed. Levels of higher shares are searched first: what they find
    above their share can't be beaten by a sentence that only lower ones meet.
    """
    shares = tuple(x for x in LEVELS if x > share) + (share,)
    a_at, a_words = _lists(answers)
    s_at, s_words = _lists(sentences)
    both = pa.concat_arrays([a_words, s_words]).dictionary_encode()
    codes = both.indices.to_numpy().astype("int64")
    a_codes, s_codes = codes[: len(a_words)], codes[len(a_words) :]
    often = np.bincount(a_codes, minlength=len(both.dictionary))
    rank = np.empty(len(often), "int64")
    rank[np.argsort(np.where(often == 0, len(a_codes) + 1, often), kind="stable")] = np.arange(len(often))  # words of no answer come last
    vocabulary = int((often > 0).sum())
    a_codes, s_codes, absent = rank[a_codes], rank[s_codes], vocabulary
    a_n, n = np.diff(a_at), np.diff(s_at)

    # a sentence's words by rarity, those of no answer (which are the rarest) first
    owner = np.repeat(np.arange(len(n)), n)
    s_codes = np.where(s_codes >= vocabulary, -1, s_codes)
    held = np.bincount(owner[s_codes >= 0], minlength=len(n))
    s_codes = s_codes[np.argsort(owner * (vocabulary + 1) + s_codes + 1, kind="stable")]
    useful = (held >= _needed(n, share)) & (_needed(n, share) <= (a_n.max() if len(a_n) else 0))
    a_codes = a_codes[np.argsort(np.repeat(np.arange(len(a_n)), a_n) * (vocabulary + 1) + a_codes, kind="stable")]

    groups, low, widths = [], 0, _WIDTHS + ((-(-int(n.max()) // 8) * 8,) if len(n) and n.max() > _WIDTHS[-1] else ())
    for width in widths:
        some = np.flatnonzero(useful & (n > low) & (n <= width))
        low = width
        if not len(some):
            continue
        table = np.full((len(some), width), absent, "int32")
        table[np.repeat(np.arange(len(some)), n[some]), _ranges(np.zeros(len(some), "int64"), n[some])] = s_codes[_ranges(s_at[some], n[some])]
        table[table < 0] = absent
        groups.append(_Sentences(table, n[some], some, shares, vocabulary))

    best, first = np.full(len(a_n), share), np.full(len(a_n), np.iinfo("int64").max)
    out = []
    step = max(1, MARK_BYTES // (vocabulary + 1))
    for begin in range(0, len(a_n), step):
        some = np.arange(begin, min(begin + step, len(a_n)))
        marks = np.zeros((len(some), vocabulary + 1), "bool")
        marks[np.repeat(np.arange(len(some)), a_n[some]), a_codes[a_at[begin] : a_at[some[-1] + 1]]] = True
        flat = marks.ravel()
        for level, limit in enumerate(shares):
            for paired in (True, False):
                open_ = some[((a_n[some] <= PAIRED_WORDS) == paired) & ((best[some] <= shares[level - 1]) if level else True)]
                if not len(open_):
                    continue
                word, word_of = a_codes[_ranges(a_at[open_], a_n[open_])], np.repeat(open_, a_n[open_])
                own, of = word, word_of
                if paired:
                    place = _ranges(np.zeros(len(open_), "int64"), a_n[open_])
                    later = np.repeat(a_n[open_], a_n[open_]) - place - 1
                    left = np.repeat(np.arange(len(word)), later)
                    own, of = word[left] * vocabulary + word[_ranges(np.arange(len(word)) + 1, later)], word_of[left]
                for group in groups:
                    by_pair = paired and group.words.shape[1] > 1
                    index, key_of = (group.pairs[level], of) if by_pair else (group.singles[level], word_of)
                    hit, at, size = index.met(own if by_pair else word)
                    ends, most, k = np.cumsum(size), max(1, COMPARED // group.words.shape[1]), 0
                    while k < len(hit):
                        until = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
                        a = np.repeat(key_of[hit[k:until]], size[k:until])
                        s = index.of[_ranges(at[k:until], size[k:until])]
                        for c in range(0, len(a), most):  # one key may have more postings than are compared at once
                            _compare(a[c : c + most], s[c : c + most], begin, flat, group, order, best, first, out)
                        k = until
    if not out:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    a, s, similarity = (np.concatenate(x) for x in zip(*out))
    kept = (best[a] > share) & (similarity == best[a]) & (order[s] == first[a])
    once = np.unique(np.stack([a[kept], s[kept]]), axis=1)
    return once[0], once[1], best[once[0]]


def _compare(a, s, begin, flat, group, order, best, first, out) -> None:
    """Take up what pairs of answer and sentence have in common: best and first are brought up to date, what may stay is added to out."""
    held = flat.take(((a - begin) * group.stride).astype("int32")[:, None] + group.words[s])
    if held.shape[1] % 8 == 0:  # eight words, each 0 or 1, are added up at once
        held = (held.view("uint64") * np.uint64(0x0101010101010101)) >> np.uint64(56)
    held = held.sum(axis=1, dtype="int64")
    similarity = held / group.n[s]
    better = np.flatnonzero(similarity >= best[a])
    a, s, similarity = a[better], group.number[s[better]], similarity[better]
    before = best[a]
    np.maximum.at(best, a, similarity)
    first[a[best[a] > before]] = np.iinfo("int64").max
    top = similarity == best[a]
    a, s, similarity = a[top], s[top], similarity[top]
    np.minimum.at(first, a, order[s])
    top = order[s] == first[a]
    if top.any():
        out.append((a[top], s[top], similarity[top]))
