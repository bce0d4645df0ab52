"""Secret scans in SQL functions alone: fixed forms by pattern, and strings of high Shannon entropy.

Candidate strings are runs of the characters of keys, with the names and separators that join them. A
window slides along each; the counts of its characters change by one in and one out at a step, and so
does the sum of n * log2(n) that its entropy follows from. A candidate is reported where one of its
windows reaches the entropy of the window's own class and no allow-list pattern explains that window, or
the parts between separators that it touches; what else the run holds does not matter. A run is split, scanned and marked
once, whatever its length, so time is in proportion to it. Everything stays in the JVM, row by row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed forms: kind -> (pattern, group that counts, least length of it).
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the same spans as [0-9a-f]+ of 24 or more: a run has no shorter match that is as long
}
#: Characters of the sliding window, and of the shortest candidate.
WINDOW = 20
#: Runs that may be secrets, and the classes their windows fall in: name -> (pattern, bits a character that a window must reach).
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "hyphenated": (r"^(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f-]+|(?=.*[A-F])[0-9A-F-]+)$", 3.0),
    "base36": (r"^(?=.*[0-9])(?:(?=.*[a-z])[0-9a-z]+|(?=.*[A-Z])[0-9A-Z]+)$", 3.7),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*[g-zG-Z+/_=-]", 3.7),
}
#: What looks random and is not a secret, in a window: characters repeated, long stretches of one letter class as in words or paths.
ALLOW = (r"(.)\1{5,}", r"[a-z]{12,}|^[A-Za-z/_-]+$")
#: And in the parts between separators that a window touches: placeholders, alphabets in order.
ALLOW_PART = r"(?i)example|placeholder|sample|dummy|changeme|your[_-]|0123456789|abcdefghij|qwertyuiop|deadbeef"
SEPARATORS = "=/_-"
KINDS = (*BASE, "entropy")
#: Matches of a text whose places are worked out together.
GROUP = 128


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, first: Column, carry: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(what is carried to an item, the item) for each item in order, as array<kind>.

    Items go in groups: an array grows by copying, so what each group puts out is built by itself and joined
    once, and the time of a text stays in proportion to its items.
    """
    def groups_of(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(held), F.lit(GROUP)), lambda at: F.slice(held, at, F.lit(GROUP)))

    def of_groups(groups: Column) -> Column:
        carried = F.aggregate(
            groups, F.array(first), lambda acc, group: F.concat(acc, F.array(F.aggregate(group, F.element_at(acc, -1), carry)))
        )
        nothing = F.array().cast(f"array<{kind}>")
        grown = lambda group, start: F.aggregate(
            group,
            F.struct(start.alias("at"), nothing.alias("out")),
            lambda acc, item: F.struct(carry(acc["at"], item).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], item))).alias("out")),
            lambda acc: acc["out"],
        )
        return _with(carried, lambda starts: F.flatten(F.zip_with(groups, F.slice(starts, 1, F.size(groups)), grown)))

    return _with(items, lambda held: F.when(F.size(held) > 0, _with(groups_of(held), of_groups)).otherwise(F.array().cast(f"array<{kind}>")))


_SPAN = "struct<start:int,kind:int,end:int,m:string>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, m>> of the leftmost non-overlapping matches, in code points.

    What split leaves between the matches and the matches themselves add up to the places.
    """
    expression = F.lit(pattern)
    found = F.regexp_extract_all(text, expression, F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"), m.alias("m")))
    placed = _scan(
        step,
        F.lit(0),
        lambda at, s: at + s["skip"] + s["size"],
        lambda at, s: F.struct((at + s["skip"]).alias("start"), F.lit(kind).alias("kind"), (at + s["skip"] + s["size"]).alias("end"), s["m"].alias("m")),
        _SPAN,
    )
    return F.when(F.rlike(text, expression), placed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that are not wholly inside one of base: none that starts before them, or there, reaches their end."""
    def marked(all_: Column, own: bool) -> Column:
        return F.transform(all_, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s["m"] if own else F.lit(None).cast("string")).alias("m")))

    told = _scan(
        F.array_sort(F.concat(marked(base, False), marked(spans, True))),  # at one place, base comes first
        F.lit(0),
        lambda reach, s: F.when(s["own"], reach).otherwise(F.greatest(reach, s["end"])),
        lambda reach, s: F.struct((s["own"] & (reach < s["end"])).alias("free"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")),
        "struct<free:boolean,start:int,end:int,m:string>",
    )
    kept = F.filter(told, lambda s: s["free"])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("kind"), s["end"].alias("end"), s["m"].alias("m")))


def _bits(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def entropies(letters: Column, window: int = WINDOW) -> Column:
    """Shannon entropy, in bits a character, of each window of that many of the letters, in order; empty where there are fewer.

    With counts n of the window's w characters it is log2(w) - sum(n * log2(n)) / w. Both the counts and the sum are carried
    from window to window. letters is used often: it must be a value and no expression (see _with).
    """
    def carried(names: Column) -> Column:
        return _with(F.transform(letters, lambda c: F.array_position(names, c).cast("int") - 1), lambda codes: slid(names, codes))

    def slid(names: Column, codes: Column) -> Column:
        counts = F.transform(names, lambda name, k: F.size(F.filter(F.slice(codes, 1, window), lambda c: c == k)))
        start = _with(counts, lambda n: F.struct(n.alias("n"), F.aggregate(n, F.lit(0.0), lambda a, x: a + _bits(x)).alias("sum")))
        moved = _scan(F.sequence(F.lit(window), F.size(codes)), start, lambda acc, i: slide(codes, acc, i), lambda acc, i: acc["sum"], "double")
        return F.transform(moved, lambda total: F.log2(F.lit(float(window))) - total / F.lit(float(window)))

    def slide(codes: Column, acc: Column, i: Column) -> Column:
        def stepped(pair: Column) -> Column:
            gone, new = pair["gone"], pair["new"]
            before, after = F.get(acc["n"], gone), F.get(acc["n"], new)
            total = acc["sum"] - _bits(before) + _bits(before - 1) - _bits(after) + _bits(after + 1)
            counts = F.transform(acc["n"], lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
            # past the last window there is no new character, and nothing reads the state
            return F.when(new.isNull() | (gone == new), acc).otherwise(F.struct(counts.alias("n"), total.alias("sum")))

        return _with(F.struct(F.get(codes, i - window).alias("gone"), F.get(codes, i).alias("new")), stepped)

    return F.when(F.size(letters) >= window, _with(F.array_distinct(letters), carried)).otherwise(F.array().cast("array<double>"))


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Greatest entropy of the candidate's windows; null for a candidate shorter than the window."""
    return _with(F.split(candidate, ""), lambda letters: F.array_max(entropies(letters, window)))


def _touched(run: Column, letters: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(bad), where bad(i) says whether the parts between separators that the window from i on touches hold an ALLOW_PART.

    A pattern lies within a part, but for ``your`` with the separator after it; so it is enough to mark where patterns begin, or
    that separator, to number separators and marks once from left to right and right to left, and to compare two counts.
    """
    one, two = "\u0001", "\u0002"
    marked = F.regexp_replace(F.regexp_replace(run, r"(?i)(?<=your)[_-]", two), rf"(?i)(?={ALLOW_PART.removeprefix('(?i)').replace('|your[_-]', '')}).", one)

    def sides(items: Column) -> Column:
        end = F.size(items)
        left = _scan(
            items, F.struct(F.lit(-1).alias("sep"), F.lit(0).alias("n")),
            lambda acc, c: F.struct(F.when(c["sep"], c["i"]).otherwise(acc["sep"]).alias("sep"), (acc["n"] + c["mark"].cast("int")).alias("n")), lambda acc, c: acc, "struct<sep:int,n:int>",
        )
        right = F.reverse(_scan(F.reverse(items), end, lambda acc, c: F.when(c["sep"], c["i"]).otherwise(acc), lambda acc, c: acc, "int"))
        return _with(F.struct(left.alias("left"), right.alias("right"), F.size(F.filter(items, lambda c: c["mark"])).alias("all")), told)

    def told(held: Column) -> Column:
        def bad(i: Column) -> Column:
            low = F.get(held["left"], i)["sep"] + 1
            high = F.get(held["right"], i + WINDOW - 1)
            return F.coalesce(F.get(held["left"], high)["n"], held["all"]) > F.get(held["left"], low)["n"]

        return use(bad)

    def items(marks: Column) -> Column:
        return F.transform(letters, lambda c, i: F.struct(i.alias("i"), c.isin(*SEPARATORS).alias("sep"), F.get(marks, i).isin(one, two).alias("mark")))

    return _with(F.split(marked, ""), lambda marks: _with(items(marks), sides))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: id_col as it is, n_assign, n_access, n_hex (fixed forms), base_sha256 (of
    the fixed forms' spans, written kind:start:end in order of start, then kind), spans (those and the
    ``entropy`` ones, written likewise). An entropy candidate wholly inside a fixed form is that secret
    already and gives no span of its own; the allow-list never touches a fixed form. A null text is an empty one:
    no spans. Repeated rows are scanned each; other columns are ignored, clashing names included.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))

    def fixed(k: int, pattern: str, group: int, least: int) -> Column:
        long_enough = lambda s: F.length(F.regexp_extract(s["m"], pattern, group)) >= least
        return _plain(F.filter(_spans(F.col("text"), pattern, k), long_enough))

    rows = rows.select("id", "text", *[fixed(k, *form).alias(kind) for k, (kind, form) in enumerate(BASE.items())])
    rows = rows.withColumn("base", F.array_sort(F.concat(*BASE)))

    lowest = min(least for _, least in CLASSES.values())

    def random_window(window: Column, bits: Column) -> Column:
        needed = F.lit(None)
        for pattern, least in CLASSES.values():
            needed = F.coalesce(needed, F.when(F.rlike(window, F.lit(pattern)), F.lit(least)))
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | F.rlike(window, F.lit(pattern))
        return F.coalesce(bits >= needed, F.lit(False)) & ~allowed

    def judged(run: Column, letters: Column, bits: Column) -> Column:
        def high(i: Column) -> Column:
            own = F.round(F.get(bits, i), 6)
            return F.when(own >= lowest, _with(F.array_join(F.slice(letters, i + 1, WINDOW), ""), lambda window: random_window(window, own))).otherwise(False)

        at = F.filter(F.sequence(F.lit(0), F.size(bits) - 1), high)
        free = lambda found: _touched(run, letters, lambda bad: F.exists(found, lambda i: ~bad(i)))
        found = _with(at, lambda found: F.when(F.size(found) == 0, False).when(~F.rlike(run, F.lit(ALLOW_PART)), True).otherwise(free(found)))
        return F.when(F.round(F.array_max(bits), 6) >= lowest, found).otherwise(False)

    def secret(s: Column) -> Column:
        judge = _with(F.split(s["m"], ""), lambda letters: _with(entropies(letters), lambda bits: judged(s["m"], letters, bits)))
        return F.when(F.rlike(s["m"], F.lit("[0-9]")), judge).otherwise(False)  # no class has letters alone

    rows = rows.withColumn("high", _plain(F.filter(_outside(_spans(F.col("text"), CANDIDATE, len(BASE)), F.col("base")), secret)))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "high")))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
    )
