"""PII: format-preserving Feistel pseudonyms, in SQL functions only.

A text is cut into what lies between finds and the finds themselves. A find that its kind's check confirms is
permuted by a keyed Feistel network within its format: cards keep their length and their Luhn digit, account numbers
(IBAN) their country and a right check number, phone numbers their country code or leading zero and, if ten digits
follow it, valid area codes, dates are valid days between 1900 and 2099, IPv4 addresses and identity numbers stay such,
letters and digits of mail names and secrets stay letters and digits. Dates are numbers or have an English month's name.
Secrets are what a named field holds: anything in quotes, letters alone straight after an equals sign, else letters and
digits mixed, six at least; what follows `Bearer`; and tokens known by their begin. They and mail names may have any
length. Left as written: unnamed secrets of other forms, words after a field's name and a blank, IPv6 addresses, months
in other languages, grouped account numbers with a number or capitals of four after them. Separators stay where they are, and the value alone (without separators, in lower case for mail) is permuted: equal values get
equal pseudonyms in all documents however written. With the key, ``undo=True`` gives the values back (but
for dates written month first whose pseudonym also reads day first, zeros before single digits of dates, and
abbreviated months that became May).

The network is additive on a pair (l, r) of Z_a x Z_b, with a * b the number of values of the format, so it is a
permutation of exactly these; for letters and digits the halves are character by character. The round function is
SHA-256 of key, kind, round and the other half. Who has the key can undo it, so it has no default.

Defined cases: null stays null, an empty text empty, finds that fail their check are kept as written; a number
that belongs to a longer one is no find; texts of any length are read whole; repeated rows get the same result; an
empty table gives no rows; other columns are kept, those named like the added ones are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
NAMES = r"token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key"
#: What stands before a secret: a field's name, an announcement, the fixed begin of a token.
FIELD = rf"(?i:(?:{NAMES})[\"']?\s*+[=:]\s*+)"
BEARER = r"(?i:bearer\s++)"
TOKEN = r"eyJ|AKIA|ASIA|gh[opsu]_"
MIXED = r"(?=[\w+/=.~-]*?\d)(?=[\w+/=.~-]*?[A-Za-z])[\w+/=.~-]{6,}+"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
NATIONAL = r"(?:\+?\d{1,3}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
TRUNK, LOCAL = r"0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}", r"\d{3}-\d{4}"
#: Kinds in the order in which they are looked for at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![\w-])",
    "secret": rf"(?:{FIELD}(?:\"[^\"\r\n]++\"|'[^'\r\n]++'|{BEARER}?{MIXED})|(?i:{NAMES})=(?!=)[\w+/.~-]++|(?<!\w){BEARER}{MIXED}"
    rf"|(?<![\w.-])(?:eyJ[\w-]++\.[\w-]++\.[\w-]++|A(?:KIA|SIA)[A-Z0-9]{{16}}(?!\w)|gh[opsu]_[A-Za-z0-9]{{36}}(?!\w)))",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": rf"(?<![\w./-])(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}} {MONTH} \d{{4}}|{MONTH} \d{{1,2}},? \d{{4}})(?![./-]?\d)",
    "ssn": r"(?<![\w-])(?:\d{3}-\d\d-\d{4}|(?<!\d )\d{3} \d\d \d{4}(?! \d))(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: \d{1,3})?)(?![A-Za-z0-9])",
    "phone": rf"(?<![\w+])(?:{NATIONAL}|\+\d(?:[ .()-]{{0,2}}\d){{7,14}}|(?<!\d[ -]){TRUNK}(?![ -]\d)|(?<![.-]){LOCAL}(?!-))(?!\d)",
    "card": r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![ -]?\d)",
}
KINDS = list(PATTERNS)
EPOCH, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days: up to 2099-12-31
QUOTE = "[\"']?"
#: What a find can begin with: most places of a text are passed over after one look. All kinds but the first two begin alike.
SECRET_BEGIN, NUMBER_BEGIN = "(?=[abegpstABEGPST])", r"(?=[\d+(A-Z])"
ANY = rf"(?:{PATTERNS['email']})|{SECRET_BEGIN}(?:{PATTERNS['secret']})|{NUMBER_BEGIN}(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in KINDS[2:])})"


def literal(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def bind(name: str, value: str, body: str) -> str:
    """SQL for `body` with `name` worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Network:
    """SQL of the permutations under a key, or of their inverses."""

    def __init__(self, key: str, undo: bool = False):
        self.key = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.sign = "-" if undo else "+"
        self.rounds = f"sequence({ROUNDS - 1}, 0, -1)" if undo else f"sequence(0, {ROUNDS - 1})"

    def hashed(self, *parts: str) -> str:
        return f"cast(conv(substring(sha2(concat_ws('|', {', '.join((self.key, *parts))}), 256), 1, 15), 16, 10) AS bigint)"

    def pair(self, kind: str, value: str, a: str, b: str) -> str:
        """The image of a number below a * b."""
        moved = lambda x, by, size: f"pmod({x} {self.sign} pmod({self.hashed(f"'{kind}'", 'i', by)}, {size}), {size})"
        step = f"if(i % 2 = 0, named_struct('l', {moved('s.l', 's.r', 'z.a')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l', 'z.b')}))"
        run = f"aggregate({self.rounds}, named_struct('l', z.v div z.b, 'r', z.v % z.b), (s, i) -> {step}, s -> s.l * z.b + s.r)"
        return bind("z", f"named_struct('v', cast({value} AS bigint), 'a', cast({a} AS bigint), 'b', cast({b} AS bigint))", run)

    def characters(self, kind: str, value: str) -> str:
        """Letters and digits moved within their alphabets; all else stays."""

        def moved(half: str, other: str) -> str:
            by = self.hashed(f"'{kind}'", "i", "j", other)
            turn = lambda first, size: f"char({first} + pmod(ascii(c) - {first} {self.sign} pmod({by}, {size}), {size}))"
            cases = f"CASE WHEN c rlike '[0-9]' THEN {turn(48, 10)} WHEN c rlike '[a-z]' THEN {turn(97, 26)} WHEN c rlike '[A-Z]' THEN {turn(65, 26)} ELSE c END"
            return f"array_join(transform(split({half}, ''), (c, j) -> {cases}), '')"

        step = f"if(i % 2 = 0, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')}))"
        cut = "char_length(z) div 2"
        return bind("z", value, f"aggregate({self.rounds}, named_struct('l', substring(z, 1, {cut}), 'r', substring(z, {cut} + 1)), (s, i) -> {step}, s -> concat(s.l, s.r))")


DIGITS = "regexp_replace(m, '[^0-9]', '')"


def refill(form: str, digits: str, places: str = "[0-9]") -> str:
    """`form` with its digits, or what else `places` names, replaced in turn by those of `digits`."""
    step = f"if(c rlike '{places}', named_struct('o', concat(s.o, substring(d, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k))"
    return bind("d", digits, f"aggregate(split({form}, ''), named_struct('o', '', 'k', 1), (s, c) -> {step}, s -> s.o)")


def luhn(digits: str, doubled_last: bool) -> str:
    """The sum of the Luhn rule; doubled_last: the last digit counts double, as it does before a check digit."""
    place = f"(char_length({digits}) - 1 - j) % 2 = {0 if doubled_last else 1}"
    value = "cast(c AS int)"
    terms = f"transform(split({digits}, ''), (c, j) -> if({place}, {value} * 2 - if({value} > 4, 9, 0), {value}))"
    return f"aggregate({terms}, 0, (x, y) -> x + y)"


def pseudonym(net: Network) -> str:
    """SQL: struct (kind, text) for a find m; the kind is null where the check fails."""
    # cards: all digits but the last are permuted, the last one is worked out
    front = bind("h", "substring(g, 1, char_length(g) - 1)", bind("w", "char_length(h)", f"lpad(cast({net.pair('card', 'cast(h AS bigint)', 'power(10, w div 2)', 'power(10, w - w div 2)')} AS string), w, '0')"))
    card = bind("g", DIGITS, f"if({luhn('g', False)} % 10 = 0, {refill('m', bind('q', front, f'concat(q, cast(pmod(-({luhn('q', True)}), 10) AS string))'))}, null)")
    # phones: 800 x 800 x 10000 numbers have valid area and exchange codes; the other 360000 x 10000 are permuted among themselves
    ten, area, exchange = (f"cast(substring(g, {x}) AS bigint)" for x in ("-10", "-10, 3", "-7, 3"))
    valid = f"({area} >= 200 AND {exchange} >= 200)"
    rank = f"(({area} - 200) * 800 + {exchange} - 200) * 10000 + {ten} % 10000"
    back = "((v div 8000000) + 200) * 10000000 + ((v div 10000) % 800 + 200) * 10000 + v % 10000"
    other = f"if({area} < 200, {area} * 1000 + {exchange}, 200000 + ({area} - 200) * 200 + {exchange}) * 10000 + {ten} % 10000"
    other_back = "if(v < 2000000000, v, ((v - 2000000000) div 2000000 + 200) * 10000000 + (v - 2000000000) % 2000000)"
    number = f"if({valid}, {bind('v', net.pair('phone', rank, '80000', '80000'), back)}, {bind('v', net.pair('phone other', other, '60000', '60000'), other_back)})"
    ten_last = f"concat(substring(g, 1, char_length(g) - 10), lpad(cast({number} AS string), 10, '0'))"
    # written otherwise: what follows the country code; if that is ten digits, the same permutation
    wide = f"lpad(cast({net.pair('phone of other length', "cast(substring(g, c + 1) AS bigint)", 'power(10, w div 2)', 'power(10, w - w div 2)')} AS string), w, '0')"
    abroad = bind("c", f"if(m rlike {literal('^' + LOCAL + '$')}, 0, char_length(regexp_extract(g, '^(?:0|{COUNTRY.replace(chr(92), chr(92) * 2)})', 0)))", bind("w", "char_length(g) - c", f"if(w = 10, {ten_last}, concat(substring(g, 1, c), {wide}))"))
    phone = bind("g", DIGITS, refill("m", f"if(m rlike {literal('^(?:' + NATIONAL + ')$')}, {ten_last}, {abroad})"))
    # identity numbers: 898 areas (no 666) x 99 groups x 9999 serials
    area, group, serial = ("cast(substring(m, %d, %d) AS bigint)" % x for x in ((1, 3), (5, 2), (8, 4)))
    good = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    rank = f"(({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    back = "concat(lpad(cast(v div 989901 + if(v div 989901 >= 665, 2, 1) AS string), 3, '0'), lpad(cast(v div 9999 % 99 + 1 AS string), 2, '0'), lpad(cast(v % 9999 + 1 AS string), 4, '0'))"
    ssn = f"if({good}, {bind('v', net.pair('ssn', rank, '88902', '9999'), refill('m', back))}, null)"
    # account numbers: country kept, what follows the check number moved, the check number worked out (98 - remainder)
    check = lambda rest: f"lpad(cast(98 - aggregate(split(concat({rest}, substring(g, 1, 2), '00'), ''), 0, (s, c) -> if(c rlike '[0-9]', s * 10 + cast(c AS int), s * 100 + ascii(c) - 55) % 97) AS string), 2, '0')"
    moved = bind("q", net.characters("iban", "substring(g, 5)"), refill("m", f"concat(substring(g, 1, 2), {check('q')}, q)", "[0-9A-Z]"))
    iban = bind("g", "replace(m, ' ', '')", f"if(substring(g, 3, 2) = {check('substring(g, 5)')}, {moved}, null)")
    # addresses
    octets = "transform(split(m, r'\\.'), o -> cast(o AS bigint))"
    back = "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)"
    ip = bind("g", octets, f"if(array_max(g) <= 255, {bind('v', net.pair('ip', 'aggregate(g, 0L, (x, o) -> x * 256 + o)', '65536', '65536'), back)}, null)")
    # dates: the day's number; day before month unless only the other order is a date
    named = "m rlike '[A-Z]'"
    number = f"cast(array_position(array({', '.join(repr(x[:3]) for x in MONTHS)}), substring(regexp_extract(m, '[A-Z][a-z]+', 0), 1, 3)) AS string)"
    in_order = f"array(regexp_extract(m, '[0-9]+', 0), {number}, substring(m, -4))"
    parts = f"transform(if({named}, {in_order}, split(m, '[-./]')), o -> if(char_length(o) = 1, concat('0', o), o))"
    iso = "m rlike '^[0-9]{4}[-/]'"
    of = lambda y, m, d: f"try_cast(concat_ws('-', g[{y}], g[{m}], g[{d}]) AS date)"
    day = f"coalesce(if({iso}, {of(0, 1, 2)}, {of(2, 1, 0)}), if({iso}, null, {of(2, 0, 1)}))"
    month_first = f"(NOT {iso} AND NOT {named} AND {of(2, 1, 0)} IS NULL)"
    form = lambda two: f"if({month_first}, '{two[1]}/{two[0]}/yyyy', '{two[0]}/{two[1]}/yyyy')"
    padded = "m rlike '^[0-9]{2}[^0-9][0-9]{2}[^0-9]'"
    day_written, word = "date_format(v, if(m rlike '(^| )0', 'dd', 'd'))", "regexp_extract(m, '[A-Z][a-z]+', 0)"
    month = f"substring(element_at(array({', '.join(map(repr, MONTHS))}), month(v)), 1, if(char_length({word}) = 3 AND {word} <> 'May', 3, 9))"
    spoken = f"if(m rlike '^[0-9]', concat_ws(' ', {day_written}, {month}, date_format(v, 'yyyy')), concat({month}, ' ', {day_written}, if(m like '%,%', ', ', ' '), date_format(v, 'yyyy')))"
    written = f"CASE WHEN {named} THEN {spoken} WHEN {iso} THEN date_format(v, if(m like '%/%', 'yyyy/MM/dd', 'yyyy-MM-dd')) ELSE translate(if({padded}, date_format(v, {form(('dd', 'MM'))}), date_format(v, {form(('d', 'M'))})), '/', if(m like '%.%', '.', '/')) END"
    image = f"date_add(date'{EPOCH}', cast({net.pair('date', f"datediff(t, date'{EPOCH}')", str(DAYS[0]), str(DAYS[1]))} AS int))"
    date = bind("g", parts, bind("t", day, f"if(t BETWEEN date'{EPOCH}' AND date'2099-12-31', {bind('v', image, written)}, null)"))
    email = f"concat({net.characters('email', "lower(substring_index(m, '@', 1))")}, '@', substring_index(m, '@', -1))"
    head = f"regexp_extract(m, {literal('^(?:' + FIELD + QUOTE + ')?' + BEARER + '?(?:' + TOKEN + ')?')}, 0)"
    tail = f"regexp_extract(m, {literal(QUOTE + '$')}, 0)"
    body = "substring(m, char_length(a) + 1, char_length(m) - char_length(a) - char_length(b))"
    secret = bind("a", head, bind("b", tail, f"concat(a, {net.characters('secret', body)}, b)"))
    made = {"email": email, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "iban": iban, "phone": phone, "card": card}
    kind = "CASE " + " ".join(f"WHEN m rlike {literal('^(?:' + strip_edges(PATTERNS[k]) + ')$')} THEN '{k}'" for k in KINDS) + " END"
    cases = "CASE k " + " ".join(f"WHEN '{k}' THEN {made[k]}" for k in KINDS) + " END"
    return bind("k", kind, bind("p", cases, "named_struct('kind', if(p IS NULL, null, k), 'text', coalesce(p, m))"))


def strip_edges(pattern: str) -> str:
    """The pattern without what it demands of the text around a find."""
    return re.sub(r"^\(\?<![^()]*\)|\(\?![^()]*\)$", "", pattern)


def pseudonymize(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """All columns of `docs`, `text` with pseudonyms, and n_<kind> for each kind: how many finds were replaced."""
    if not key:
        raise ValueError("a key is needed")
    net = Network(key, undo)
    counts = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in counts]
    found = F.expr(f"transform(regexp_extract_all(text, {literal(ANY)}, 0), m -> {pseudonym(net)})")
    own = docs.select(*kept).withColumn("__finds", found)
    gaps = F.expr(f"split(text, {literal(ANY)}, -1)")  # one more than finds
    renewed = F.array_join(F.zip_with(gaps, "__finds", lambda g, f: F.concat(g, F.coalesce(f["text"], F.lit("")))), "")
    text = F.when(F.size("__finds") > 0, renewed).otherwise(F.col("text"))
    return own.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], *[count_of(k).alias(f"n_{k}") for k in KINDS])


def count_of(kind: str) -> Column:
    return F.coalesce(F.size(F.filter("__finds", lambda f: f["kind"] == kind)), F.lit(0))
