"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too
much of its text goes with them.

A line that holds a word fails if one of these rules says so:

* navigation: three or more menu marks (| > » · •) or marks making up a tenth of its words' characters;
* symbols: more than a tenth of its characters are of `#*$%&|<>`;
* shouting: at least three words, and seven tenths of its letters that have cases are capitals;
* boilerplate: it holds a stock phrase of web pages (cookie notices, script warnings, ...);
* punctuation: no sentence ends in it, neither at its end nor before a blank.

The verdict keeps a document if the base checks pass (50 words at least, at most half of the words in
repeated three-word windows) and the lines left hold at least `1 - max_loss` of the word characters.

Defined results: a null text counts as empty and fails; every row is judged by itself, so repeated
rows get equal answers; lines are cut at line feeds only; a very long text is judged whole; an empty table gives none; there are no ties; columns of documents of
any name are kept, but one named as the result is replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, session_ready, struct_of, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.3
SYMBOLS = b"#*$%&|<>"
MENU_MARKS = ("|", ">", "»", "·", "•")
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？")
CLOSERS = "\"')]”’»*_"
#: Stock phrases of web pages, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of use",
    "use of cookies",
)
_BLANKS = " \t\n\v\f\r"


def failing_rule(line: str) -> str | None:
    """Name of the first rule that the line fails; None if it passes or holds no word."""
    body = line.strip(_BLANKS)
    if not body:
        return None
    marks = sum(body.count(m) for m in MENU_MARKS)
    if marks and (marks >= 3 or 10 * marks >= len(body)):
        return "navigation"
    if 10 * sum(body.count(chr(c)) for c in SYMBOLS) > len(body):
        return "symbols"
    if body.count(" ") >= 2:
        upper = sum(map(str.isupper, body))
        if upper and 10 * upper >= 7 * (upper + sum(map(str.islower, body))):
            return "shouting"
    low = body.lower()
    if any(p in low for p in BOILERPLATE):
        return "boilerplate"
    if body.rstrip(CLOSERS)[-1:] in SENTENCE_ENDS:
        return None
    if any(f"{e} " in body for e in SENTENCE_ENDS):
        return None
    return "punctuation"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = upto = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _BLANKS))


def judge(data: bytes | None, max_loss: float = MAX_LOSS) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, characters left, cleaned text."""
    data = data or b""
    text = data.decode("utf-8", "replace")
    words = data.split()
    chars = word_chars(text)
    lines = text.split("\n")
    seen: set[str] = set()
    repeats = removed = left = 0
    stay = []
    for line in lines:
        here = word_chars(line)
        if here:
            repeats += line in seen
            seen.add(line)
            if failing_rule(line):
                removed += 1
                continue
            left += here
        stay.append(line)
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and left >= (1 - max_loss) * chars
    return len(words), chars, sum(map(data.count, (bytes([c]) for c in SYMBOLS))), repeats, n_repeat, failed, kept, removed, left, "\n".join(stay)


_FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "n_lines_removed": pa.int64(),
    "n_chars_left": pa.int64(),
    "cleaned": pa.string(),
}
_DDL = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,n_lines_removed:bigint,n_chars_left:bigint,cleaned:string>"


def clean_lines(docs: DataFrame, text: str = "text", into: str = "quality", max_loss: float = MAX_LOSS, with_text: bool = True) -> DataFrame:
    """docs with a struct `into`: counts, base_failed, kept and, unless with_text is False, the text left."""
    session_ready(docs.sparkSession)

    @F.arrow_udf(_DDL)
    def judged(column: pa.Array) -> pa.Array:
        out = [judge(t, max_loss) for t in as_bytes(column)]
        cols = list(zip(*out, strict=True)) or [()] * len(_FIELDS)
        if not with_text:
            cols[-1] = [None] * len(out)
        return struct_of({k: (t, list(c)) for (k, t), c in zip(_FIELDS.items(), cols, strict=True)})

    return docs.withColumn(into, judged(F.col(text)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs, with_text=False).select("doc_id", *[F.col(f"quality.{k}").alias(k) for k in list(_FIELDS)[:9]])


def _any_of(marks) -> str:
    return "".join(f"\\{m}" if m in "|.!?*$" else m for m in marks)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM many) GROUP BY doc_id),
line AS (SELECT doc_id, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
counted AS (SELECT *, len(regexp_extract_all(body, '[{_any_of(MENU_MARKS)}]')) AS marks, len(regexp_extract_all(body, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(body, ' ')) AS blanks,
    len(regexp_extract_all(body, '\p{{Lu}}')) AS upper, len(regexp_extract_all(body, '\p{{Ll}}')) AS lower FROM line WHERE chars > 0),
judged AS (SELECT doc_id, line, chars, (marks > 0 AND (marks >= 3 OR 10 * marks >= length(body))) OR 10 * symbols > length(body) OR (blanks >= 2 AND upper > 0 AND 10 * upper >= 7 * (upper + lower))
    OR {" OR ".join(f"contains(lower(body), '{p}')" for p in BOILERPLATE)}
    OR NOT (regexp_matches(rtrim(body, '{CLOSERS.replace("'", "''")}'), '[{_any_of(SENTENCE_ENDS)}]$') OR regexp_matches(body, '[{_any_of(SENTENCE_ENDS)}] ')) AS fails FROM counted),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, CAST(coalesce(sum(chars) FILTER (NOT fails), 0) AS BIGINT) AS n_chars_left FROM judged GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed,
    coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_chars_left, 0) AS n_chars_left FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, NOT base_failed AND n_chars_left >= CAST({1 - MAX_LOSS} AS DOUBLE) * word_chars AS kept FROM base
"""
