"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust scores.

Everything is a column expression; no Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .frames import id_and_text

#: Spans with a lower score are no findings. Base findings stay whatever their score.
LEAST_SCORE = 0.6
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: Matches of a text that are walked together.
CHUNK = 64
#: No pattern matches fewer characters.
LEAST_MATCH = 4

# The patterns below match what the plain forms in their comments match, from left
# to right without overlaps, but never scan a run of characters twice: a match may
# only begin where a run begins or where the last match ended (\G), and runs are
# taken whole (++).
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"


class Kind(NamedTuple):
    """How one kind of finding is proposed, confirmed and scored."""

    name: str
    pattern: str
    hint: str  # a cheap condition on `text` without which there is no match
    valid: str  # a condition on x.match
    score: float
    context: str  # words that add 0.3 when they stand near
    base: bool = True


_DIGITS = "regexp_replace(x.match, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether a digit string's sum, every second digit from the right doubled and cast out, ends in 0."""
    digit = f"cast(substr({digits}, i, 1) as int)"
    doubled = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    each = f"if((length({digits}) - i) % 2 = 1, {doubled}, {digit})"
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + {each}) % 10 = 0"


def mod97(text: str) -> str:
    """SQL: whether the first four characters, moved to the end, give a number with remainder 1 (letters are 10 to 35)."""
    code = f"ascii(substr(concat(substr({text}, 5), substr({text}, 1, 4)), i, 1))"
    step = f"if({code} >= 65, (t * 100 + {code} - 55) % 97, (t * 10 + {code} - 48) % 97)"
    return f"aggregate(sequence(1, length({text})), 0, (t, i) -> {step}) = 1"


def _between(digits: str, least: int, most: int) -> str:
    return f"length({digits}) between {least} and {most}"


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CARD_WORDS = "card|visa|credit|debit|mastercard|amex|payment"
_PHONE_WORDS = "phone|tel|call|mobile|cell|fax|whatsapp"

KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++", "contains(text, '@')",
         "true", 0.8, "mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
         rf"x.match rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'", 0.6, "ip|host|server|address"),
    # [0-9]([ -]?[0-9])+ with 14 to 19 digits: shorter runs need not be proposed
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", "text rlike '[0-9](?:[ -]?[0-9]){13}'",
         f"{_between(_DIGITS, 14, 19)} and {luhn(_DIGITS)}", 0.8, _CARD_WORDS),
    # \+[0-9][ ().0-9-]+[0-9] with 10 to 15 digits
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')", _between(_DIGITS, 10, 15), 0.7, _PHONE_WORDS),
    # A card's own digits within a longer run of numbers, which the plain form takes as one.
    Kind("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])",
         "text rlike '[0-9](?:[ -]?[0-9]){12}'", luhn(_DIGITS), 0.6, _CARD_WORDS, False),
    # National phone forms count only beside a word for them.
    Kind("phone", r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
         r"text rlike '[0-9]{3}[ .-][0-9]{4}'", "true", 0.3, _PHONE_WORDS, False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         r"text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'",
         f"length(replace(x.match, ' ', '')) between 15 and 34 and {mod97('replace(x.match, ' + repr(' ') + ', ' + repr('') + ')')}",
         0.8, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         "text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "true", 0.3, "ssn|social security|taxpayer", False),
)
NAMES = ("email", "ip", "card", "phone", "iban", "ssn")


def _quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _findings(kind: Kind) -> str:
    """SQL: the confirmed spans of a kind in `text`, with offsets in code points.

    The pieces between matches (split) and the matches give all offsets by adding
    up lengths, and the text around a match, other matches included: what stands
    before is carried along, what follows is put together from as many pieces as
    can be needed. The work grows with the matches. Texts without the hint, nearly all,
    cost one search.
    """
    pattern, number = _quoted(kind.pattern), NAMES.index(kind.name)
    near = f"concat(' ', x.before, ' ', x.after, ' ') rlike '[^a-z](?:{kind.context})[^a-z]'"
    empty = "cast(array() as array<struct<start:int,stop:int,match:string,before:string,after:string>>)"
    start = "a.at + length(v.s[i - 1])"
    stop = f"{start} + length(v.m[i - 1])"
    before = f"right(concat(a.tail, right(v.s[i - 1], {BEFORE})), {BEFORE})"
    most = AFTER // LEAST_MATCH
    pieces = f"""flatten(zip_with(slice(v.s, i + 1, {most + 1}), slice(v.m, i + 1, {most}),
        (s, m) -> array(left(s, {AFTER}), left(m, {AFTER}))))"""
    # An array grows by a copy of itself: matches are walked in chunks, whose first offsets are summed up first.
    ahead = BEFORE // LEAST_MATCH
    length = f"""aggregate(zip_with(slice(v.s, (c - 1) * {CHUNK} + 1, {CHUNK}), slice(v.m, (c - 1) * {CHUNK} + 1, {CHUNK}),
        (s, m) -> length(s) + length(m)), 0, (t, x) -> t + x)"""
    offsets = f"""aggregate(if(size(v.m) <= {CHUNK}, cast(array() as array<int>), sequence(1, (size(v.m) - 1) div {CHUNK})),
        array(0), (t, c) -> concat(t, array(element_at(t, -1) + {length})))"""
    held = f"greatest(c * {CHUNK} - {ahead - 1}, 1), {ahead}"
    tail = f"""if(c = 0, '', right(array_join(flatten(zip_with(slice(v.s, {held}), slice(v.m, {held}),
        (s, m) -> array(right(s, {BEFORE}), right(m, {BEFORE})))), ''), {BEFORE}))"""
    chunk = f"""aggregate(sequence(c * {CHUNK} + 1, least((c + 1) * {CHUNK}, size(v.m))),
        named_struct('at', o[c], 'tail', {tail}, 'spans', {empty}),
        (a, i) -> named_struct('at', {stop}, 'tail', right(concat({before}, right(v.m[i - 1], {BEFORE})), {BEFORE}),
            'spans', concat(a.spans, array(named_struct(
                'start', {start}, 'stop', {stop}, 'match', v.m[i - 1],
                'before', lower({before}), 'after', lower(left(array_join({pieces}, ''), {AFTER})))))),
        a -> a.spans)"""
    walk = f"""if(size(v.m) = 0, {empty}, flatten(transform(array({offsets}), o ->
        flatten(transform(sequence(0, cast((size(v.m) - 1) div {CHUNK} as int)), c -> {chunk})))))"""
    score = f"{kind.score}D + if({near}, 0.3D, 0D)"
    found = f"""transform(filter({walk}, x -> {kind.valid}), x -> named_struct(
        'start', x.start, 'kind', {number}, 'stop', x.stop, 'score', least(1D, {score}), 'base', {str(kind.base).lower()}))"""
    # An array of one lets the matches be named, and so be made once.
    bound = f"array(named_struct('m', regexp_extract_all(text, {pattern}, 0), 's', split(text, {pattern}, -1)))"
    nothing = "cast(array() as array<struct<start:int,kind:int,stop:int,score:double,base:boolean>>)"
    return f"if({kind.hint}, transform({bound}, v -> {found})[0], {nothing})"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) per row: arrays of (start, kind, stop, score, base), by start, kind and stop.

    kind is a place in NAMES, offsets count code points, `stop` is exclusive.
    `base` holds all confirmed matches of the base patterns; `added` what the other
    patterns find with a score of LEAST_SCORE or more and outside of base findings of
    their kind. Scores are a kind's own plus 0.3 for a context word nearby.

    A null text is empty and has no findings; ids may be null or repeated; other
    columns are ignored; an empty table gives no rows. Texts are searched whole.
    Rows are independent: nothing is shuffled, broadcast or collected.
    """
    rows = id_and_text(df, id_col, text_col)
    parts = [F.expr(_findings(k)).alias(f"k{n}") for n, k in enumerate(KINDS)]
    found = rows.select("id", *parts)
    base = F.array_sort(F.concat(*[f"k{n}" for n, k in enumerate(KINDS) if k.base]))
    more = F.concat(*[f"k{n}" for n, k in enumerate(KINDS) if not k.base])
    both = found.select("id", base.alias("base"), more.alias("more"))
    added = F.expr(
        f"array_sort(filter(more, m -> m.score >= {LEAST_SCORE}D and not exists(base, b -> b.kind = m.kind "
        "and b.start <= m.start and m.stop <= b.stop)))"
    )
    return both.select("id", "base", added.alias("added"))


def described(findings: Column | str) -> Column:
    """Findings as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    column = F.col(findings) if isinstance(findings, str) else findings
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])
    return F.array_join(F.transform(column, one), ",")


def counted(kind: str) -> Column:
    """How many base findings are of a kind."""
    return F.size(F.filter("base", lambda x: x["kind"] == NAMES.index(kind))).cast("long")


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every finding replaced by its kind in angle brackets; overlapping findings by the first."""
    rows = id_and_text(df, id_col, text_col)
    every = F.concat(*[F.expr(_findings(k)) for k in KINDS])
    sure = F.filter(every, lambda x: x["base"] | (x["score"] >= LEAST_SCORE))
    found = rows.select("id", "text", F.array_sort(sure).alias("all"))
    names = "array(" + ", ".join(f"'<{n}>'" for n in NAMES) + ")"
    step = f"""if(x.start < a.at, a, named_struct('at', x.stop, 'text',
        concat(a.text, substr(text, a.at + 1, x.start - a.at), {names}[x.kind])))"""
    out = f"aggregate(all, named_struct('at', 0, 'text', ''), (a, x) -> {step}, a -> concat(a.text, substr(text, a.at + 1)))"
    return found.select("id", F.expr(out).alias("text"))
