"""Line-first cleaning (operator 2).

Every line of a text is judged by itself: navigation, boilerplate, symbol load and end punctuation.  Lines that fail are
removed, and a document that loses too large a share of its words is rejected.  Base figures of the whole text (words,
symbols, repeated lines and repeated three-word windows) are computed in the same pass.  One pass, no shuffle; memory is
bounded by one Arrow batch.

Defined cases: a null or empty text has no words and fails the base rules; lines without words are neither judged nor
counted; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

SYMBOLS = "#*$%&|<>"
#: Characters that may end a sentence, with or without closing quotes and brackets after them.
SENTENCE_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
#: Separators of menus and breadcrumbs.
NAVIGATION = re.compile(r"\s[|»›>·•/]\s|^\s*(?:home|menu|next|previous|back to top|skip to (?:main )?content|log ?in|sign (?:in|up))\s*[|»›>·]?\s*$", re.I)
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "lorem ipsum", "click here", "read more", "sign up for our newsletter", "subscribe to our", "share this article",
    "powered by", "copyright ©", "we use cookies",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_share: int = 50  # percent
    max_symbol_share: float = 0.1  # of a line's characters
    min_navigation_marks: int = 2
    max_lost_share: float = 0.5  # of a document's words


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_failed_lines long, lost_words long, kept boolean, clean_text string"


def line_fails(line: str, rules: Rules = Rules()) -> str | None:
    """The rule that a line (with a word) fails, or None."""
    bare = line.strip()
    low = bare.lower()
    if any(x in low for x in BOILERPLATE):
        return "boilerplate"
    if len(NAVIGATION.findall(bare)) >= rules.min_navigation_marks or NAVIGATION.fullmatch(bare):
        return "navigation"
    if sum(map(bare.count, SYMBOLS)) > rules.max_symbol_share * len(bare):
        return "symbols"
    if not SENTENCE_END.search(bare):
        return "punctuation"
    return None


def repeated_words(words: list) -> int:
    """Words that stand in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """The columns of OUT after doc_id, for one text."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n, lines, dup, failed, lost = len(words), 0, 0, 0, 0
    seen, clean = set(), []
    for line in text.split("\n"):
        in_line = len(line.encode().split())
        if not in_line:
            clean.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line, rules):
            failed += 1
            lost += in_line
        else:
            clean.append(line)
    repeats = repeated_words(words)
    base = n < rules.min_words or 100 * repeats > rules.max_repeat_share * n
    kept = not base and lost <= rules.max_lost_share * n
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, base, lines, failed, lost, kept, "\n".join(clean) if kept else None


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: base figures, lines failed, words lost, verdict and the text that is left (null if rejected)."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        for b in batches:
            rows = [judge(t, rules) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, OUT)
