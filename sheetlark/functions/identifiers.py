"""Brazilian identifiers and bank data as column expressions: patterns and check digits.

A CNPJ may hold letters in its first twelve places, each of the value of its code less 48; one with letters counts only
in its written form (``XX.XXX.XXX/XXXX-00``), since any word could be one otherwise. An IBAN holds if it has its country's
length and its number, first four signs last and letters as 10 to 35, leaves 1 modulo 97. A PIX key is told by
its name next to it, and by its shape: e-mail, phone, random key, CPF or CNPJ.

A number counts only if it stands alone (no letter or digit next to it) and its check
digits hold; numbers of one repeated digit never count. Eleven digits may be a CPF and a
PIS at once: both are told.
"""

from __future__ import annotations

#: Weights of the check digits, as published by the issuing bodies.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
PIS_WEIGHTS = ((3, 2, 9, 8, 7, 6, 5, 4, 3, 2),)

_ALONE = r"(?<![0-9A-Za-zÀ-ÿ]){}(?![0-9A-Za-zÀ-ÿ])"
PATTERNS = {
    "cpf": _ALONE.format(r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}"),
    "cnpj": _ALONE.format(r"(?:\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}|[0-9A-Z]{2}\.[0-9A-Z]{3}\.[0-9A-Z]{3}/[0-9A-Z]{4}-\d{2})"),
    "pis": _ALONE.format(r"\d{3}\.?\d{5}\.?\d{2}-?\d"),
    "bank_account": r"(?i)(?<![a-zÀ-ÿ])ag(?:[êe]ncia)?\.?:?\s*\d{3,5}(?:-[\dx])?\s*[,;/|-]?\s*(?:conta(?: corrente)?|c/?c|cta)\.?:?\s*\d{3,12}-?[\dx]?(?![0-9A-Za-zÀ-ÿ])",
    "iban": _ALONE.format(r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"),
    "pix_key": r"(?i)(?<![a-zÀ-ÿ])pix(?:[: =-]|\s|é|e chave|chave){0,4}(?:[a-z0-9._+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,4}|\+55\d{10,11}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{3}\.?\d{3}\.?\d{3}-?\d{2}|\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})(?![0-9a-zÀ-ÿ@])",
    "card": _ALONE.format(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}"),
}
REPEATED = r"^(\d)\1*$"
DIGITS = "regexp_replace({}, '[^0-9]', '')"
CHARACTERS = "regexp_replace({}, '[^0-9A-Z]', '')"
#: Lengths of IBANs by country; others may have 15 to 34 signs.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BR": 29, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


# Expressions are SQL text over a column's name: a check is some hundred operators, which the
# JVM parses at once.


def _with(value: str, make) -> str:
    """``make`` of a value that is worked out once, however often it is used there."""
    return f"get(transform(array({value}), n -> {make('n')}), 0)"


def _weighted(number: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"ascii(substring({number}, {i}, 1)) * {w}" for i, w in enumerate(weights, 1)) + f" - {48 * sum(weights)})"


def check_digit(number: str, weights: tuple[int, ...]) -> str:
    """11 minus the weighted sum modulo 11, where 10 and 11 count as 0."""
    return f"((11 - {_weighted(number, weights)} % 11) % 11 % 10)"


def holds(number: str, weights: tuple[tuple[int, ...], ...]) -> str:
    """Whether a string of digits has the right length and check digits and is not one repeated digit."""
    fits = lambda n, w: f"{check_digit(n, w)} = ascii(substring({n}, {len(w) + 1}, 1)) - 48"
    return _with(number, lambda n: f"(length({n}) = {len(weights[-1]) + 1} AND NOT {n} RLIKE r'{REPEATED}' AND {' AND '.join(fits(n, w) for w in weights)})")


def luhn(number: str) -> str:
    """Sixteen digits, not one repeated, whose Luhn sum is a multiple of ten."""
    make = lambda n: f"(length({n}) = 16 AND luhn_check({n}) AND replace({n}, left({n}, 1), '') <> '')"
    # a plain column needs no lambda, so it stays in generated code
    return make(number) if number.isidentifier() else _with(number, make)


def modulo_97(digits: str) -> str:
    """A string of digits of any length modulo 97, sixteen digits at a time."""
    return f"aggregate(sequence(1, greatest(length({digits}), 1), 16), 0, (rest_, at_) -> CAST(CAST(concat(rest_, substring({digits}, at_, 16)) AS BIGINT) % 97 AS INT))"


def iban(text: str) -> str:
    """Whether an IBAN, without spaces, has its country's length and leaves 1 modulo 97."""
    lengths = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")"

    def fits(t: str) -> str:
        size = f"length({t}) BETWEEN 15 AND 34 AND length({t}) = coalesce({lengths}[left({t}, 2)], length({t}))"
        # runs of digits go on at once, a letter is two digits more
        parts = f"regexp_extract_all(concat(substring({t}, 5, 40), left({t}, 4)), '[A-Z]|[0-9]{{1,16}}', 0)"
        rest = f"aggregate({parts}, 0L, (rest_, p_) -> CASE WHEN p_ < 'A' THEN CAST(concat(rest_, p_) AS BIGINT) ELSE rest_ * 100 + ascii(p_) - 55 END % 97)"
        return f"({size} AND {rest} = 1)"

    return _with(text, fits)


WEIGHTS = {"cpf": CPF_WEIGHTS, "cnpj": CNPJ_WEIGHTS, "pis": PIS_WEIGHTS}


def check(number: str, kind: str) -> str:
    return luhn(number) if kind == "card" else holds(number, WEIGHTS[kind])


def found(text: str, kind: str) -> str:
    """Array of the values of ``kind`` in a text, as written there."""
    every = f"regexp_extract_all({text}, r'{PATTERNS[kind]}', 0)"
    if kind in ("bank_account", "pix_key"):
        return every
    if kind == "iban":
        return f"filter({every}, v -> {iban("replace(v, ' ', '')")})"  # its pattern takes no other sign
    return f"filter({every}, v -> {check((CHARACTERS if kind == 'cnpj' else DIGITS).format('v'), kind)})"


def found_in_number(value: str, kind: str) -> str:
    """The same for a numeric cell, which has lost its leading zeros."""
    size = len(WEIGHTS[kind][-1]) + 1
    return f"filter(array(lpad({value}, {size}, '0')), v -> {value} RLIKE r'^\\d{{{size - 3},{size}}}$' AND {check('v', kind)})"
