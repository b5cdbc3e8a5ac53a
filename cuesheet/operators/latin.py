"""Sound-alike matching of Latin words that speech recognition spelt by ear."""

from __future__ import annotations

import functools
import re

from ..sources.dictionaries import Dictionary

VOWELS = frozenset("aeiouy")
#: Costs in hundredths: a vowel put in, left out or exchanged; a consonant put in or left out; r for l or c for s.
VOWEL, CONSONANT, SWAP = 25, 35, 40
SWAPS = frozenset({("r", "l"), ("l", "r"), ("c", "s"), ("s", "c")})
ALIKE = {"r": "l", "s": "c"}
MOST_VOWELS, MOST_CONSONANTS = 2, 1


def fold(word: str) -> str:
    """Neighbouring equal consonants become one."""
    return re.sub(r"([^aeiouy])\1+", r"\1", word)


def bones(word: str) -> str:
    """The consonants of a word, those of SWAPS as one."""
    return "".join(ALIKE.get(c, c) for c in word if c not in VOWELS)


def shortened(word: str) -> set[str]:
    """A word with one character left out, in each way."""
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def sound_score(heard: str, target: str) -> tuple[float, float] | None:
    """(similarity, place of the gaps: less is earlier) of the cheapest alignment within the budget, or None.

    An alignment may put in, leave out or exchange two vowels and put in or leave out one consonant.
    """
    n, m = len(heard), len(target)

    @functools.cache
    def best(i: int, j: int, vowels: int, consonants: int) -> tuple[int, int] | None:
        """Least (cost, sum of gap places) for the rest from i and j with what is left of the budget."""
        if i == n and j == m:
            return 0, 0
        found = []

        def take(cost: int, place: int, rest: tuple[int, int] | None) -> None:
            if rest is not None:
                found.append((cost + rest[0], place + rest[1]))

        for char, place, at in ((heard[i : i + 1], i + 1, (i + 1, j)), (target[j : j + 1], j + 1, (i, j + 1))):
            if char and char in VOWELS and vowels:
                take(VOWEL, place, best(*at, vowels - 1, consonants))
            elif char and char not in VOWELS and consonants:
                take(CONSONANT, place, best(*at, vowels, consonants - 1))
        if i < n and j < m:
            a, b = heard[i], target[j]
            if a == b:
                take(0, 0, best(i + 1, j + 1, vowels, consonants))
            elif a in VOWELS and b in VOWELS and vowels:
                take(VOWEL, 0, best(i + 1, j + 1, vowels - 1, consonants))
            elif (a, b) in SWAPS:
                take(SWAP, 0, best(i + 1, j + 1, vowels, consonants))
        return min(found, default=None)

    cheapest = best(0, 0, MOST_VOWELS, MOST_CONSONANTS)
    return cheapest and (1 - cheapest[0] / 100 / max(n, m), cheapest[1] / max(n, m))


class SoundMatcher:
    """Finds the correct word that a misheard one sounds like."""

    def __init__(self, d: Dictionary):
        self.d = d
        self.words: list[tuple[str, float, str, tuple[str, ...]]] = []
        seen = set()
        latin = [(t.term, t.confidence, ()) for t in d.terms if re.fullmatch("[A-Za-z0-9]{2,}", t.term)]
        for term, confidence, spoken in [(s.term, s.confidence, s.spoken) for s in d.surface] + latin:
            if term.lower() not in seen:
                seen.add(term.lower())
                self.words.append((term, confidence, fold(term.lower()), tuple(fold(x.lower()) for x in spoken)))
        self.exact = {w[2] for w in self.words}
        self.targets = [(target, term, confidence) for term, confidence, written, spoken in self.words for target in (written, *spoken)]
        self.same: dict[str, set[int]] = {}
        self.longer: dict[str, set[int]] = {}
        for k, (target, _, _) in enumerate(self.targets):
            self.same.setdefault(bones(target), set()).add(k)
            for b in shortened(bones(target)):
                self.longer.setdefault(b, set()).add(k)

    def _worth(self, token: str) -> str | None:
        """The folded token, unless it must be left alone: digits, capitals inside, stop words, correct words."""
        if len(token) < self.d.min_token or not re.fullmatch("[A-Z]?[a-z]+", token):
            return None
        low = token.lower()
        heard = fold(low)
        return None if {low, heard} & self.d.stopwords or heard in self.exact else heard

    def _near(self, heard: str) -> list[int]:
        """Places of targets that an alignment can reach: with MOST_CONSONANTS (1) put in or left out their consonants are those of heard."""
        b = bones(heard)
        found = self.same.get(b, set()) | self.longer.get(b, set())
        return sorted(found.union(*(self.same.get(x, ()) for x in shortened(b))))

    def match(self, token: str) -> tuple[str, float, float] | None:
        """(term, score, confidence) or None."""
        heard = self._worth(token)
        if heard is None:
            return None
        found: list[tuple[float, float, str, float]] = []
        for k in self._near(heard):
            target, term, confidence = self.targets[k]
            if heard == target:
                return term, 0.98, confidence
            near = heard[0] == target[0] and len(heard) <= len(target) + 1 and min(len(heard), len(target)) / max(len(heard), len(target)) >= 0.6
            if near and (hit := sound_score(heard, target)) and hit[0] > 0:
                found.append((*hit, term, confidence))
        if not found:
            return None
        found.sort(key=lambda x: -x[0])
        top = found[0][0]
        ties = [x for x in found if top - x[0] <= 0.02]
        rest = found[len(ties)][0] if len(ties) < len(found) else 0.0
        if top < (self.d.short_threshold if len(heard) == 2 else self.d.threshold) or top - rest < self.d.margin:
            return None
        score, _, term, confidence = min(ties, key=lambda x: x[1])
        return term, score, confidence
