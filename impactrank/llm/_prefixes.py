"""Token counts of every prefix of a string under a byte-pair model, one step a character.

The tokens of a prefix are those of a shorter prefix and one token more.  Which one
follows from the prefixes before: a token t that ends a prefix is its last if the
last token u of the prefix before t stays beside it, that is, if the model cuts the
string u + t into u and t.  Exactly one t does.  So a table of last tokens and counts
is filled from left to right, and nothing is encoded again.
"""

from __future__ import annotations

SPACE = "▁"


class PrefixProgram:
    """The dynamic program for a sentencepiece BPE model; strings are normalised (spaces as marks, one before the text)."""

    def __init__(self, library):
        self.score, self.bytes = {}, False
        for i in range(library.get_piece_size()):
            if library.is_byte(i):
                self.bytes = True
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.score[library.id_to_piece(i)] = library.get_score(i)
        self.longest = max(map(len, self.score), default=1)
        self.beside: dict[tuple[str, str], bool] = {}
        self.held: tuple[str, list[str], list[int]] = ("", [""], [0])

    def cut(self, text: str) -> list[str]:
        """The pieces of a short string: the best pair is merged first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, u: str, t: str) -> bool:
        key = (u, t)
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) > 200_000:
                self.beside.clear()
            found = self.beside[key] = self.cut(u + t) == ([u, t] if u else [t])
        return found

    def cost(self, u: str, t: str) -> int:
        """Tokens that t adds after u: an unknown character is its bytes, or one token for a run of them."""
        if t in self.score:
            return 1
        if self.bytes:
            return len(t.encode())
        return int(not u or u in self.score)

    def counts(self, text: str) -> list[int] | None:
        """Tokens of the first 1, 2, ... characters; None if no token fits somewhere (the model is no pure BPE).

        What the last string has in common with this one is not done again, so strings
        in order of the alphabet cost least.
        """
        before, last, count = self.held
        same, most = 0, min(len(text), len(count) - 1)
        while same < most and text[same] == before[same]:
            same += 1
        last, count, score = last[: same + 1], count[: same + 1], self.score
        for p in range(same + 1, len(text) + 1):
            for size in range(min(self.longest, p), 0, -1):
                t = text[p - size : p]
                if (size == 1 or t in score) and self.stays(last[p - size], t):
                    count.append(count[p - size] + self.cost(last[p - size], t))
                    last.append(t)
                    break
            else:
                return None
        self.held = text, last, count
        return count[1:]
