"""A text as tokens: numbers, words, marks, signs, gaps and single other characters, steps along them, and columns read
from them in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(?P<number>\d+(?:,\d{3}(?!\d))*(?:\.\d+)?|\.\d+)|(?P<word>[A-Za-z]+)|(?P<mark>[°º˚'′’\"″”])|(?P<sign>[-−–])|(?P<gap>\s+)|(?P<other>.)", re.DOTALL)


class Tokens:
    """kinds, what is said, and words in small letters (other tokens as they are)."""

    def __init__(self, text: str) -> None:
        found = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]
        self.kinds, self.said = [k for k, _ in found], [t for _, t in found]
        self.words = [t.lower() if k == "word" else t for k, t in found]

    def __len__(self) -> int:
        return len(self.kinds)

    def kind(self, i: int) -> str | None:
        return self.kinds[i] if 0 <= i < len(self) else None

    def word(self, i: int) -> str | None:
        return self.words[i] if 0 <= i < len(self) else None

    def over(self, i: int, step: int, *kinds: str) -> int:
        """The first place from i on, forwards or backwards, that is of no such kind."""
        while self.kind(i) in kinds:
            i += step
        return i

    def next(self, i: int) -> int:
        """The next place that is no gap."""
        return self.over(i + 1, 1, "gap")

    def numbers(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == "number"]

    def value(self, i: int) -> float:
        return float(self.said[i].replace(",", ""))

    def phrase(self) -> str:
        """All tokens but gaps, each between blanks, so that phrases can be looked for."""
        return " " + " ".join(w for w, k in zip(self.words, self.kinds, strict=True) if k != "gap") + " "

    def says(self, *phrases: str) -> bool:
        whole = self.phrase()
        return any(f" {p} " in whole for p in phrases)

    def without(self, taken: set[int]) -> Tokens:
        """These tokens with gaps in place of those taken."""
        made = Tokens("")
        made.kinds, made.said, made.words = (["gap" if i in taken else k for i, k in enumerate(self.kinds)], [" " if i in taken else t for i, t in enumerate(self.said)], [" " if i in taken else w for i, w in enumerate(self.words)])
        return made


def each(ddl: str, read: Callable[[str], tuple | None], text: Column) -> Column:
    """A struct of what is read of each text, null where nothing is."""
    names = [c.split()[0] for c in ddl.split(", ")]

    @F.pandas_udf(f"{ddl}, there boolean")
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = [read(t) if t else None for t in texts]
        frame = pd.DataFrame([r or (None,) * len(names) for r in rows], columns=names)
        frame = frame.astype({c.split()[0]: {"double": "float64", "int": "Int32", "boolean": "boolean", "string": "object"}[c.split()[1]] for c in ddl.split(", ")})
        return frame.assign(there=[r is not None for r in rows])

    return F.get(F.transform(F.array(made(text)), lambda r: F.when(r["there"], F.struct(*(r[n].alias(n) for n in names)))), 0)
