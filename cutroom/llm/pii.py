"""Personal data by anchor expansion: Aho-Corasick finds at-signs, schemes, digits and cues, and a
deterministic local parser expands each anchor to its boundaries and validates it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cutroom.session import ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LABEL = _LETTERS | _DIGITS | {"-"}
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
_SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
_CUES = ("iban", "account", "acct")
_machines: list = []


def _machine():
    if not _machines:
        import ahocorasick

        found = ahocorasick.Automaton()
        for digit in _DIGITS:
            found.add_word(digit, ("digit", 1))
        found.add_word("@", ("at", 1))
        found.add_word("+", ("plus", 1))
        for kind, words in (("url", _SCHEMES), ("account", _CUES)):
            for word in words:
                for form in {word, word.upper(), word.capitalize()}:
                    found.add_word(form, (kind, len(form)))
        found.make_automaton()
        _machines.append(found)
    return _machines[0]


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at at."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign: the local part back to floor at most, then labels with a dot between."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end, dots = _run(text, end + 1, _LABEL), dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int) -> int | None:
    """End of four digit runs with dots between."""
    end = _run(text, at, _DIGITS)
    for _ in range(3):
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS):
            return None
        end = _run(text, end + 1, _DIGITS)
    return end


def _card(text: str, at: int) -> int | None:
    """End of the longest chain of digits with a space or hyphen at most between two."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end if end > at + 1 else None


def _phone(text: str, at: int) -> int | None:
    """From the plus sign: a digit, then the run of phone characters cut back to its last digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in _DIGITS else None


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _decimal(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind in KINDS, end) in order; offsets in characters, end exclusive."""
    spans: list[tuple[int, int, int]] = []
    free = [0] * len(KINDS)  # where the next match of the kind may start
    last_digit = -2
    for last, (anchor, size) in _machine().iter(text):
        at = last - size + 1
        if anchor == "digit":
            fresh, last_digit = at != last_digit + 1, at
            # inside a run of digits only the run's start, or the end of the last match, can begin a match
            if (fresh or at == free[1]) and at >= free[1] and (end := _ip(text, at)) is not None:
                free[1] = end
                if all(_decimal(part) for part in text[at:end].split(".")):
                    spans.append((at, 1, end))
            if at >= free[2] and (fresh or at == free[2]) and (end := _card(text, at)) is not None:
                free[2] = end
                digits = [ord(c) - 48 for c in text[at:end] if c in _DIGITS]
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((at, 2, end))
        elif anchor == "at":
            if at >= free[0] and (found := _email(text, at, free[0])) is not None:
                free[0] = found[1]
                spans.append((found[0], 0, found[1]))
        elif anchor == "plus":
            if at >= free[3] and (end := _phone(text, at)) is not None:
                free[3] = end
                if 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    spans.append((at, 3, end))
        elif anchor == "url":
            if at >= free[4] and not (at and text[at - 1] in _LABEL):
                end = last + 1
                while end < len(text) and text[end] not in _URL_END:
                    end += 1
                while end > last + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end - last > 3:
                    free[4] = end
                    spans.append((at, 4, end))
        elif at >= free[5] and not (at and text[at - 1] in _LABEL):
            # a cue, up to 12 characters that name or separate, then an identifier of 8 to 34 with 6 digits
            begin = last + 1
            while begin < len(text) and begin - last <= 12 and text[begin] in " :#=.noNO":
                begin += 1
            end = begin
            while end < len(text) and (text[end] in _LETTERS or text[end] in _DIGITS or (text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS)):
                end += 1
            body = [c for c in text[begin:end] if c not in " -"]
            if 8 <= len(body) <= 34 and sum(c in _DIGITS for c in body) >= 6:
                free[5] = end
                spans.append((begin, 5, end))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]], base_only: bool = False) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans if not base_only or kind < len(BASE_KINDS))


def stretches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, placeholder) of every maximal stretch of spans, named after its first one."""
    out: list[tuple[int, int, str]] = []
    for start, kind, end in find_spans(text):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, f"<{KINDS[kind].upper()}>"))
    return out


def redacted(text: str) -> str:
    """The text with every maximal stretch of spans replaced by its placeholder."""
    out, done = [], 0
    for start, end, name in stretches(text):
        out += [text[done:start], name]
        done = end
    return "".join([*out, text[done:]]) if out else text


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns one row per input row: id_col as it is, n_email, n_ip, n_card, n_phone (base kinds), base_sha256
    (of the base spans, written kind:start:end), spans (all kinds, written likewise). A null text is an empty
    one: no spans. Repeated rows are searched each; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, texts = [[] for _ in BASE_KINDS], [], []
            for text in batch.column("text"):
                spans = find_spans(text.as_py() or "")
                for k, held in enumerate(counts):
                    held.append(sum(kind == k for _, kind, _ in spans))
                digest.append(hashlib.sha256(written(spans, base_only=True).encode()).hexdigest())
                texts.append(written(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(texts, pa.string())],
                ["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(text: Column) -> Column:
    """A text column with personal data replaced; null stays null."""

    @pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else redacted(t))

    return clean(text)


def edits_of(text: str | None) -> list[dict]:
    """What redact() does to a text, as edits (start, stop, text) from the last to the first; null has none."""
    return [{"start": a, "stop": b, "text": name} for a, b, name in reversed(stretches(text or ""))]


def redactions(text: Column) -> Column:
    """edits_of() of a column."""

    @pandas_udf("array<struct<start: int, stop: int, text: string>>")
    def listed(texts):  # noqa: ANN001, ANN202
        return texts.map(edits_of)

    return listed(text)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, personal data in text_col replaced and length_col, if any, counted anew."""
    ship(docs.sparkSession)
    out = docs.withColumn(text_col, redact(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out
