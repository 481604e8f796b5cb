"""SQL spellings of the column functions, for the comparison statements."""

from millrace.functions.columns import NUMBER
from millrace.operators.docs import DROPPED_TAGS, ENTITIES
from millrace.operators.text import NOUN_ENDINGS, STOP_WORDS, TERM, TOKEN, WORD

# The same white space spelled out, for an engine whose \s is ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def number(x: str) -> str:
    return f"case when regexp_matches({x}, '{NUMBER}') then cast(trim({x}) as double) end"


def rating(x: str) -> str:
    return number(f"replace({x}, '/5', '')")


def plain_number(x: str) -> str:
    return number(f"replace({x}, ',', '')")


def magnitude(x: str) -> str:
    t = f"upper(trim({x}))"
    scaled = " ".join(
        f"when contains({t}, '{s}') then ({number(f'replace({t}, {quoted(s)}, {quoted('')})')}) * {f}"
        for s, f in (("K", "1e3"), ("M", "1e6"), ("B", "1e9"))
    )
    return f"case {scaled} else {number(t)} end"


def normalized(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), {quoted(SPACE)}, ' ', 'g')), '')"


def cleaned(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(SPACE)}, ' ', 'g'))"


def token_list(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(TOKEN)})"


def term_list(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quoted(TERM)})"


def without_stop_words(x: str) -> str:
    words = ", ".join(quoted(w) for w in STOP_WORDS)
    return f"list_filter({x}, lambda t: regexp_matches(t, {quoted(WORD)}) and t not in ({words}))"


def nouns(x: str) -> str:
    rules = " ".join(
        f"when ends_with(t, '{e}') then concat(left(t, length(t) - {len(e)}), '{b}')" for e, b in NOUN_ENDINGS
    )
    plain = "when ends_with(t, 's') and not ends_with(t, 'ss') and not ends_with(t, 'us') then left(t, length(t) - 1)"
    return f"list_transform({x}, lambda t: case {rules} {plain} else t end)"


def page_text(x: str) -> str:
    for tag in DROPPED_TAGS:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', chr(10), 'g')"
    for name, char in ENTITIES:
        # names also count without the semicolon
        x = f"regexp_replace({x}, {quoted(name + '?')}, {quoted(char)}, 'g')" if name[1] != "#" else f"replace({x}, {quoted(name)}, {quoted(char)})"
    return cleaned(x)
