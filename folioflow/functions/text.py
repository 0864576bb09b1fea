"""Text preparation as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import lists

# A stripped line that ends in a page marker, or is a number between dashes or alone.
PAGE_FURNITURE = (
    rf"(?iu)(?:{V.PAGE_MARK})[{V.WS}]*\p{{Nd}}+$"
    rf"|^[-–—{V.WS}]*\p{{Nd}}+[-–—{V.WS}]*$"
)
MAY_END_FURNITURE = r"[\p{Nd}–—-]"
SENTENCE_END = rf"(?s)^(.*[.!?][{V.WS}]+)"
LAST_SPACE = r"(?s)^(.*) "


def strip(text: Column) -> Column:
    """Trim every Unicode space on both sides; plain trim() only knows U+0020."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(V.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(V.WHITESPACE))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def narration_lines(raw: Column) -> Column:
    """Stripped lines without blanks and page furniture."""

    def is_furniture(line: Column) -> Column:
        # Looking at the last character first spares most lines the long pattern.
        return F.right(line, F.lit(1)).rlike(MAY_END_FURNITURE) & line.rlike(PAGE_FURNITURE)

    lines = F.transform(F.split(raw, V.LINE_BREAK), strip)
    return F.filter(lines, lambda line: (line != "") & ~is_furniture(line))


def close_text(joined: Column) -> Column:
    """Collapse runs of spaces and end the text with a sentence mark."""

    def collapse(text: Column) -> Column:
        return F.when(
            F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")
        ).otherwise(text)

    def end(text: Column) -> Column:
        ended = (text == "") | F.right(text, F.lit(1)).isin(".", "!", "?")
        return F.when(ended, text).otherwise(F.concat(text, F.lit(".")))

    return bind(bind(joined, collapse), end)


def clean_text(raw: Column) -> Column:
    """Raw page text as one line of narration. Empty stays empty."""
    # The kept lines are stripped, so the joined text needs no outer trim.
    return close_text(F.array_join(narration_lines(raw), " "))


def split_parts(text: Column, max_chars: int = V.PART_CHARS) -> Column:
    """Array of parts of at most `max_chars` characters.

    A part ends after the last sentence end that lies in the window, else at the
    last space, else at the window's edge. The text is first cut into blocks of
    `max_chars`; the fold then works on a buffer of at most two blocks, so the
    cost grows linearly with the text.
    """
    return bind(text, lambda t: _split_bound(t, max_chars))


def _split_bound(text: Column, max_chars: int) -> Column:
    length = F.length(text)
    # After the first cut only the stripped rest counts, so trailing space behind
    # the first window can go at once.
    tail = F.substring(text, F.lit(max_chars + 1), F.greatest(length, F.lit(1)))
    trimmed = F.concat(F.substring(text, 1, max_chars), rstrip(tail))
    blocks = F.regexp_extract_all(trimmed, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
    folded = bind(blocks, lambda b: _fold_blocks(b, max_chars))
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(length <= max_chars, F.array(text))
        .otherwise(folded)
    )


def _fold_blocks(blocks: Column, max_chars: int) -> Column:
    n_blocks = F.size(blocks)

    def state(buf: Column, taken: Column, parts: Column) -> Column:
        return F.struct(buf.alias("buf"), taken.alias("taken"), parts.alias("parts"))

    def append(s: Column) -> Column:
        joined = F.concat(s["buf"], F.get(blocks, s["taken"]))
        buf = F.when(lists.is_empty(s["parts"]), joined).otherwise(lstrip(joined))
        return state(buf, s["taken"] + 1, s["parts"])

    def cut_length(window: Column) -> Column:
        by_word = F.when(
            F.contains(window, F.lit(" ")), F.length(F.regexp_extract(window, LAST_SPACE, 1))
        ).otherwise(max_chars)
        sentence = F.length(F.regexp_extract(window, SENTENCE_END, 1))
        return bind(sentence, lambda k: F.when(k > 0, k).otherwise(by_word))

    def cut(s: Column) -> Column:
        def at_position(k: Column) -> Column:
            rest = F.substring(s["buf"], k + 1, F.lit(2 * max_chars))
            rest = F.when(s["taken"] >= n_blocks, strip(rest)).otherwise(lstrip(rest))
            part = strip(F.substring(s["buf"], F.lit(1), k))
            return state(rest, s["taken"], lists.append(s["parts"], part))

        return bind(bind(F.substring(s["buf"], 1, max_chars), cut_length), at_position)

    def step(s: Column, _: Column) -> Column:
        full = F.length(s["buf"]) > max_chars
        return (
            F.when(~full & (s["taken"] < n_blocks), append(s))
            .when(full | lists.is_empty(s["parts"]), cut(s))
            .otherwise(s)
        )

    start = state(F.lit(""), F.lit(0), lists.empty("string"))
    # Three parts in a row cover at least one window, and each block is taken once.
    steps = F.sequence(F.lit(1), n_blocks * 4 + 6)
    return F.aggregate(
        steps,
        start,
        step,
        lambda s: lists.whole(
            F.when(s["buf"] == "", s["parts"]).otherwise(lists.append(s["parts"], s["buf"]))
        ),
    )


def derive_title(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?s)\.[^.]*\z", "")
    return _or_default(strip(F.translate(stem, "_-", "  ")), V.DEFAULT_TITLE)


def _or_default(text: Column, default: str) -> Column:
    return bind(text, lambda t: F.when(t == "", default).otherwise(t))


def slug(name: Column) -> Column:
    words = strip(F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_{V.WS}-]", ""))
    joined = F.regexp_replace(words, rf"[{V.WS}]+", "_")
    return _or_default(F.substring(joined, 1, V.SLUG_CHARS), V.DEFAULT_SLUG)


def file_hash(content: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(content, 256)
