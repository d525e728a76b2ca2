"""SQL spellings of message classification, for the checks."""

from __future__ import annotations

from ..functions import intents

SPACES = "' ' || chr(9) || chr(10) || chr(13)"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9_-]+', ' ', 'g'))"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


INTENT_SQL = "case when n = '' then 'greeting' " + " ".join(
    f"when n in ({quoted(phrases)})" + (" or (length(n) < 30 and regexp_matches(n, '\\bvoltar\\b') and regexp_matches(n, '\\bmenu\\b'))" if name == "menu_return" else "")
    + f" then '{name}'" for name, phrases in intents.INTENT_PHRASES.items()
) + f" when len(string_split(n, ' ')) <= 3 and list_has_any(string_split(n, ' '), [{quoted(intents.GREETING_WORDS)}]) then 'greeting' else 'content' end"


def inline_sql(mode: str) -> str:
    wanted = intents.inline_pattern(mode, False) + "(.+)$"
    return (f"case when regexp_matches(n, '{wanted}') then nullif(trim(regexp_replace(content, "
            f"'(?i){intents.inline_pattern(mode, True)}', ''), {SPACES}), '') end")
