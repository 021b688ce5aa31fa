"""The prose of a document: sentences, without headings, code, logs, tables and markup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|div|li|br|h\d|tr|td|ul|ol)\b[^>\n]{0,60}>", re.I)
_TAG = re.compile(r"</?[a-z][^>\n]{0,60}>", re.I)
_LIST_MARK = re.compile(r"^\s*(?:[-*>]\s+)+")
_NO_PROSE = re.compile(r"^(?:[|#{\[$]|[A-Za-z_]\w*(?:\[\w*\])?\s*=[^=]|for \w+ in \w+:)")
_STOP = re.compile(r"(?<=[.!?])\s+")
_ENDS = re.compile(r"[.!?:]['\")\]]*$")
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s{2,}")
#: Parts without an end mark of fewer words between blanks are headings and captions.
_LEAST_UNMARKED = 5


def sentences(text: str | None, least_words: int = 3, starts: Collection[str] = ()) -> list[list[str]]:
    """Words (letters only, lower case) of each sentence.

    Prose without end marks counts too: it is cut at wider gaps and before the words in
    ``starts`` (``sentence_starts``). A short line without an end mark (a heading, a
    fragment), a table row, a log line, a line of code or data and anything within a code
    fence is no sentence. A null or empty text has none.
    """
    out = []
    for part, marked in _parts(text):
        for piece in [part] if marked else _unmarked(part, starts):
            words = _WORD.findall(piece.lower())
            if len(words) >= least_words:
                out.append(words)
    return out


def sentence_starts(texts: Iterable[str | None]) -> Counter[tuple[str, bool]]:
    """How often each capitalised word stands first in a sentence with an end mark (``True``) and within one (``False``)."""
    out: Counter[tuple[str, bool]] = Counter()
    for text in texts:
        for part, marked in _parts(text):
            if marked:
                out.update((w, k == 0) for k, w in enumerate(part.split()) if w[0].isupper())
    return out


def _unmarked(part: str, starts: Collection[str]) -> Iterator[str]:
    """Sentences of a part without an end mark."""
    if sum(any(c.isalpha() for c in w) for w in part.split()) < _LEAST_UNMARKED:
        return
    for run in _GAP.split(part):
        words = run.split()
        cuts = [0, *(k for k in range(1, len(words)) if words[k] in starts), len(words)]
        for a, b in zip(cuts, cuts[1:]):
            yield " ".join(words[a:b])


def _parts(text: str | None) -> Iterator[tuple[str, bool]]:
    """Parts of the lines that may be prose, and whether each has an end mark."""
    if not text:
        return
    text = _TAG.sub(" ", _BLOCK_TAG.sub("\n", _FENCE.sub("\n", text.replace("\r", ""))))
    for line in text.split("\n"):
        line = _LIST_MARK.sub("", line).strip()
        if not line or _NO_PROSE.match(line):
            continue
        for part in _STOP.split(line):
            yield part, bool(_ENDS.search(part))
