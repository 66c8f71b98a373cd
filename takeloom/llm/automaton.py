"""Levenshtein automata run over a trie of terms.

The automaton of a token is nondeterministic, with one bit per position and one word of bits per number of slips; walking the trie feeds it the
letters of all terms at once, and a branch ends where no state is left.
"""

from __future__ import annotations


def without(word: str, letters: int) -> set[str]:
    """The word, and what is left of it without up to so many letters."""
    out, last = {word}, {word}
    for _ in range(letters):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Trie:
    def __init__(self, terms: set[str], most: int = 2):
        self.root: dict = {}
        #: What is left of the terms without up to `most` of their letters: a word within so many slips shares one of these with a term.
        self.left = [frozenset(x for t in terms for x in without(t, k)) for k in range(most + 1)]
        self.longest = max(map(len, terms), default=0)
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def near(self, token: str, most: int, wildcard: str = "?") -> list[tuple[int, str]]:
        """(slips, term) for each term within `most` slips of token: a letter changed, dropped, added, or two swapped. A wildcard is any one letter.

        Words that share no remainder with a term are turned away before the walk; none that is near is lost by that.
        """
        if len(token) > self.longest + most:
            return []
        if wildcard not in token and most < len(self.left) and self.left[most].isdisjoint(without(token, most)):
            return []
        m = len(token)
        masks: dict[str, int] = {}
        anything = 0
        for i, c in enumerate(token):
            if c == wildcard:
                anything |= 1 << i
            else:
                masks[c] = masks.get(c, 0) | 1 << i
        start = tuple((1 << (e + 1)) - 1 for e in range(most + 1))  # dropped letters at the front
        found: list[tuple[int, str]] = []
        stack = [(self.root, start, None, 0)]
        while stack:
            node, states, before, seen_before = stack.pop()
            for c, child in node.items():
                if c == "":
                    slips = next((e for e, s in enumerate(states) if s >> m & 1), None)
                    if slips is not None:
                        found.append((slips, child))
                    continue
                seen = masks.get(c, 0) | anything
                new = []
                for e in range(most + 1):
                    s = (states[e] & seen) << 1
                    if e:
                        s |= states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1
                        if before is not None:  # token[i], token[i+1] stand as token[i+1], token[i] in the term
                            s |= (before[e - 1] & (seen_before >> 1) & seen) << 2
                    new.append(s & ((1 << (m + 1)) - 1))
                if any(new):
                    stack.append((child, tuple(new), states, seen))
        return sorted(found)
