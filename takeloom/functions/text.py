"""Text normalisation for scoring, as Column expressions; the order of the steps matters and is fixed in normalize().

The SQL builders take a dialect, so the same rule can be stated for Spark and for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FIXED VALUES: number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
#: FIXED VALUES: words of the symbols.
SYMBOLS = {"$": "dollars", "%": "percent", "\u00b0": "degrees"}


def _list(words: list[str], duck: bool) -> str:
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"[{quoted}]" if duck else f"array({quoted})"


def _at(words: list[str], index: str, duck: bool) -> str:
    """Word number index, from 0."""
    return f"list_extract({_list(words, True)}, cast({index} as bigint) + 1)" if duck else f"element_at({_list(words, False)}, cast({index} as int) + 1)"


def _under_thousand(n: str, duck: bool) -> str:
    div = "//" if duck else "div"
    two = f"({n} % 100)"
    tail = f"case when {two} = 0 then null when {two} < 20 then {_at(ONES, two, duck)} when {two} % 10 = 0 then {_at(TENS, f'({two} {div} 10)', duck)} else concat({_at(TENS, f'({two} {div} 10)', duck)}, '-', {_at(ONES, f'({two} % 10)', duck)}) end"
    return f"concat_ws(' ', case when {n} >= 100 then concat({_at(ONES, f'({n} {div} 100)', duck)}, ' hundred') end, {tail})"


def _under_billion(n: str, duck: bool) -> str:
    div = "//" if duck else "div"
    parts = []
    for unit, name in ((1_000_000, "million"), (1_000, "thousand")):
        part = f"({n} {div} {unit} % 1000)"
        parts.append(f"case when {part} > 0 then concat({_under_thousand(part, duck)}, ' {name}') end")
    return f"concat_ws(' ', {', '.join(parts)}, nullif({_under_thousand(f'({n} % 1000)', duck)}, ''))"


def number_words_sql(digits: str, duck: bool = False) -> str:
    """SQL that spells a run of digits: 143 -> one hundred forty-three; above a billion, billions are counted in the same words, so any length works."""
    size = "len" if duck else "length"
    significant = f"ltrim({digits}, '0')" if duck else f"trim(leading '0' from {digits})"
    if duck:
        groups = f"list_transform(range(0, (len({significant}) + 8) // 9), lambda g: cast(substr(lpad({significant}, cast(((len({significant}) + 8) // 9) * 9 as integer), '0'), g * 9 + 1, 9) as bigint))"
        spelled = f"list_transform({groups}, lambda n: {_under_billion('n', True)})"
        joined = f"rtrim(regexp_replace(array_to_string(list_transform({spelled}, lambda w: case when w = '' then '' else ' ' || w end), ' billion'), '^ ', ''))"
    else:
        groups = f"transform(sequence(0, ({size}({significant}) + 8) div 9 - 1), g -> cast(substr(lpad({significant}, cast((({size}({significant}) + 8) div 9) * 9 as int), '0'), cast(g * 9 + 1 as int), 9) as int))"
        spelled = f"transform({groups}, n -> {_under_billion('n', False)})"
        joined = f"trim(array_join(transform({spelled}, w -> case when w = '' then '' else concat(' ', w) end), ' billion'))"
    return f"case when {significant} = '' then 'zero' else {joined} end"


_PIECES = "\\$[0-9]+|[0-9]+%|[0-9]+\u00b0|[0-9]+|[$%\u00b0]|[^0-9$%\u00b0]+"


def expanded_sql(text: str, duck: bool = False) -> str:
    """SQL that writes symbols and digits of a text as words; a symbol at a number takes its spoken place and is set apart by blanks."""
    digits = "regexp_extract(p, '[0-9]+')" if duck else "regexp_extract(p, '[0-9]+', 0)"
    number = number_words_sql("d", duck)
    spell = f"list_extract(list_transform([{digits}], lambda d: {number}), 1)" if duck else f"transform(array({digits}), d -> {number})[0]"
    starts = "starts_with" if duck else "startswith"
    ends = "ends_with" if duck else "endswith"
    cases = []
    for symbol, word in SYMBOLS.items():
        cases.append(f"when p = '{symbol}' then ' {word} '")
        near = f"{starts}(p, '{symbol}')" if symbol == "$" else f"{ends}(p, '{symbol}')"
        if symbol == "$":
            cases.append(f"when {near} then concat(' ', {spell}, ' {word} ')")
        else:
            cases.append(f"when {near} and regexp_matches(p, '^[0-9]') then concat(' ', {spell}, ' {word} ')" if duck else f"when {near} and p rlike '^[0-9]' then concat(' ', {spell}, ' {word} ')")
    is_number = "regexp_full_match(p, '[0-9]+')" if duck else "p rlike '^[0-9]+$'"
    body = f"case {' '.join(cases)} when {is_number} then {spell} else p end"
    if duck:
        return f"array_to_string(list_transform(regexp_extract_all({text}, '{_PIECES}'), lambda p: {body}), '')"
    pieces = _PIECES.replace("\\", "\\\\")
    return f"array_join(transform(regexp_extract_all({text}, '{pieces}', 0), p -> {body}), '')"


def normalized_sql(text: str) -> str:
    """DuckDB SQL of normalize(): its patterns have no look-around, so apostrophes between letters are set aside first."""
    t = f"regexp_replace({expanded_sql(f'lower({text})', True)}, '[-:]', ' ', 'g')"
    inner = r"'([\p{L}\p{N}])''([\p{L}\p{N}])'"
    for _ in range(2):
        t = rf"regexp_replace({t}, {inner}, '\1' || chr(57344) || '\2', 'g')"
    t = rf"replace(regexp_replace({t}, '[^\p{{L}}\p{{N}}\s' || chr(57344) || ']', '', 'g'), chr(57344), '''')"
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def expand(text: str) -> Column:
    """Symbols and digits of a text column as words."""
    return F.expr(expanded_sql(f"`{text}`"))


def number_words(digits: str) -> Column:
    """Words of the digits in a column of strings; leading zeros don't count, no digits give NULL."""
    return F.expr(f"case when `{digits}` rlike '^[0-9]+$' then {number_words_sql(f'`{digits}`')} end")


def normalize(text: str) -> Column:
    """Tokens of a text column: lower case, symbols and digits spelled, hyphens and colons as blanks, other punctuation gone except an apostrophe
    between letters or digits, split at white space. NULL stays NULL, a text without words has no tokens. Digits are 0-9.
    """
    lowered = F.expr(expanded_sql(f"lower(`{text}`)"))
    apart = F.regexp_replace(lowered, "[-:]", " ")
    kept = F.regexp_replace(apart, r"(?U)[^\p{L}\p{N}\s']|(?<![\p{L}\p{N}])'|'(?![\p{L}\p{N}])", "")
    return F.filter(F.split(kept, r"(?U)\s+"), lambda w: w != "")


def simple_tokens(text: str) -> Column:
    """The plainer rule of alignment: lower case, ASCII punctuation stripped at the edges of each word, hyphens inside kept."""
    edge = r"""^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"""
    return F.filter(F.transform(F.split(F.lower(F.trim(F.col(text))), r"\s+"), lambda w: F.regexp_replace(w, edge, "")), lambda w: w != "")
