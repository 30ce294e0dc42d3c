"""Language identification word by word, by definition, with none of the operator's code; the fixed values are its own."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np

from warraq.llm.language_id import _SCRIPTS, BUCKETS, ORDERS, SCRIPT_SHARE, SWITCH_PENALTY

_STARTS = [lo for lo, _ in _SCRIPTS]
_M64 = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]


def script_of(word: str) -> str:
    return _SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


@cache
def buckets_of(word: str) -> tuple[int, ...]:
    data, out = b"\x01" + word.encode() + b"\x02", []
    for n in ORDERS:
        for i in range(len(data) - n + 1):
            x = int.from_bytes(bytes([n]) + data[i : i + n], "big") & _M64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> shift)) * factor & _M64
            out.append((x ^ (x >> 31)) % BUCKETS)
    return tuple(out)


class Brute:
    def __init__(self, rows: list[tuple[str | None, str | None]]):
        """rows: text and language."""
        grams, scripts = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            if text is not None and lang is not None:
                for word, n in Counter(words_of(text)).items():
                    scripts[lang][script_of(word)] += n
                    for b in buckets_of(word):
                        grams[lang][b] += n
        self.langs = sorted(grams)
        self.grams, self.total = grams, {x: sum(grams[x].values()) for x in self.langs}
        self.admits = {x: {s for s, n in scripts[x].items() if n / sum(scripts[x].values()) >= SCRIPT_SHARE} for x in self.langs}
        self.score = cache(self._score)

    def _score(self, word: str) -> tuple[list[float], bool]:
        """(score for each language, is the word evidence)."""
        script = script_of(word)
        if not any(script in self.admits[x] for x in self.langs):
            return [0.0] * len(self.langs), False
        out = []
        for x in self.langs:
            logs = (float(np.float32(math.log((self.grams[x][b] + 0.5) / (self.total[x] + 0.5 * BUCKETS)))) for b in buckets_of(word))
            out.append(sum(logs) / len(ORDERS) if script in self.admits[x] else -1e6)
        return [max(s - max(out), -50.0) for s in out], True

    def predict(self, text: str | None, penalty: float = SWITCH_PENALTY) -> tuple[str, float]:
        words, k = words_of(text), len(self.langs)
        if not words or not k:
            return "und", 0.0
        scores = [self.score(w) for w in words]
        best, back = list(scores[0][0]), []
        for own, _ in scores[1:]:
            jump, source = max(best) - penalty, best.index(max(best))
            back.append([source if jump > best[j] else j for j in range(k)])
            best = [max(best[j], jump) + own[j] for j in range(k)]
        at = best.index(max(best))
        labels = [at]
        for step in reversed(back):
            at = step[at]
            labels.append(at)
        labels.reverse()
        letters = [0] * k
        for w, j, (_, evidence) in zip(words, labels, scores, strict=True):
            letters[j] += len(w) * evidence
        pick = letters.index(max(letters))
        like = [sum(s[j] for s, _ in scores) for j in range(k)]
        post = [math.exp(x - max(like)) for x in like]
        sure = max(post[pick] / sum(post), 1 - math.exp(-max(letters) / 50))
        return self.langs[pick], min(max(letters) / max(sum(letters), 1) * sure, 1.0)
