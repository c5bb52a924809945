"""Personal data: surrogates that keep type, format, gender and script, in built-in functions only.

A surrogate is a keyed bijection, without fixed points, of the entity's own characters: each
letter or digit moves within its class (digit, hexadecimal digit, upper or lower case vowel or
consonant of its script). The bijection is a Feistel network over the two halves of a value whose round
function is HMAC-SHA-256 (format-preserving encryption), then a shift that moves the first such
character, then the network taken back: as hard to undo without the key as the network, and no
value stays. It is applied to what tells entities apart (an email in lower case, the digits of a
number, an IBAN without blanks), and the format is put back, so equal entities get equal surrogates
everywhere (coreference) and different ones of a type different ones (distinctness) without any
table of what was replaced. Names known to the lists are exchanged within their list (gender, script,
given or family name) by a keyed rotation; other words never become one of them. In a text that
names persons, later mentions of a single word of their names are replaced alike.

`collisions` is the check: it looks through all distinct entities of the corpus and returns the
surrogates that two share, or that leave an entity as it was. `replace` runs it first, and
takes the next key where it finds any.

Types: email, iban, card (its check digit stays right or wrong as it was), ip (version 4 and 6),
ssn and some other national numbers, phone (the country code stays), secret, date of birth, street address, and
names after a title or a phrase that announces one, or beginning with a listed given name. A name without
any of these isn't found.

Every pattern is linear: what is open-ended is possessive and begins only where no character of its
kind stands before.

Defined cases: a null text stays null with 0 entities; texts without entities are unchanged;
a long text, and a long entity, is scanned whole; equal rows are rewritten alike; an empty table stays empty; a value
without a letter or digit ("password: ________") has nothing to hide and stays; a key that is missing or
shorter than 16 bytes is refused; a column named n_entities gives way to the result, all others pass through.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora|Señor|Doña|Sra|г-жа|г-н)"
# Common given names by gender and script, and family names.
FEMALE = """Mary Emma Julia Laura Sarah Alice Sophie Claire Maria Lucia Carmen Helga Ingrid Greta Olivia Hannah Nadia Paula Martha
Anna Elena Isabella Charlotte Amelia Sofia Camila Valentina Fatima Aisha Leila Priya Ananya Deepika Lakshmi Mei Yuki Sakura Ngozi Amara Chloe Ines
Katharina Johanna Birgit Monique Giulia Francesca Beatriz Mariana Zeynep Elif Jennifer Jessica Amanda Stephanie Rebecca Rachel Katherine Elizabeth Patricia""".split()
MALE = """James John Robert Michael David Thomas Peter Daniel Pierre Jacques Carlos Miguel Pablo Hans Klaus Stefan Oliver Henry Martin
William Joseph Charles Christopher Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicolas Julien
Wolfgang Jürgen Giovanni Marco Luca Diego Javier Alejandro Mohammed Ahmed Omar Hassan Ravi Arjun Rahul Vikram Hiroshi Kenji Chidi Mehmet Mustafa""".split()
FEMALE_CYRILLIC = ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Екатерина", "Людмила"]
MALE_CYRILLIC = ["Иван", "Сергей", "Алексей", "Дмитрий", "Андрей", "Николай", "Михаил", "Владимир", "Александр", "Павел"]
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Lee Perez
Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera
Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dubois Durand Lefebvre Moreau Rossi Ferrari Kumar Singh Patel Sharma Wang Chen Kim Tanaka""".split()
_GIVEN_NAMES = [FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC]
_NAMES = [*_GIVEN_NAMES, FAMILY]
_GIVEN = "|".join(n for names in _GIVEN_NAMES for n in names)
_WORD = r"\p{Lu}[\p{L}'’\-]++"
_CUES = r"(?:[Mm]y name is|[Nn]ame:|[Ff]ull name:|[Ss]igned by|[Ss]igned,|[Rr]egards,|[Ss]incerely,|[Cc]ontact person:|[Aa]ttn:|[Pp]atient:|[Cc]ustomer:|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es)"
_BORN = r"(?i:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|née? le|nacid[oa] el)"

#: In this order at each place of the text: the first that fits is the entity's type.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,}+|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}+\b|\b[0-9a-f]{32,64}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.\-])\d{13,19}(?![\d\-]|\.\d)|(?<!\d)\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?!\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){2,6}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,6}:[0-9A-Fa-f]{1,4}(?![\w:])",
    "born": rf"\b{_BORN}:? (?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./\-]\d{{1,2}}[./\-]\d{{4}})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|\b[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|\b\d{8}-?[A-HJ-NP-TV-Z]\b",
    "phone": r"(?<![\d+])\+\d{1,3}[ \-.]?\(?\d{2,4}\)?(?:[ \-.]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[\-.]\d{4}(?!\d)|(?<![\d\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])",
    "address": r"(?<![\d.,\-])\d{1,5} (?:\p{Lu}\p{Ll}{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square)\b",
    "name": rf"\b(?=[\p{{Lu}}г]){_TITLES}\.? {_WORD}(?: {_WORD})?+|\b(?=\p{{Lu}})(?:{_GIVEN}) \p{{Lu}}\p{{Ll}}[\p{{L}}'’\-]++|(?=\p{{Lu}})(?<=\b{_CUES} ){_WORD}(?: {_WORD}){{1,2}}+",
}
_numbered = dict(PATTERNS, card=PATTERNS["card"].replace(r"([ \-])", r"(?<sep>[ \-])").replace(r"\1", r"\k<sep>"))
ENTITY = "|".join(f"(?:{p})" for p in _numbered.values())
#: Also every capitalized word: it may be a later mention of a name.
MENTION = ENTITY + rf"|(?:(?<![\p{{L}}'’\-]){_WORD})"
_BARE = r"^\p{Lu}[\p{L}'’\-]+$"
#: What every entity of a type holds, each alternative of its pattern with its own part: texts without any need no scan.
HINTS = {
    "email": "@",
    "secret": r"\b(?i:token|secret|passw|pwd|api|access)|\bAKIA[0-9A-Z]{16}|\bgh[pousr]_[A-Za-z0-9]{36}|\bsk-[A-Za-z0-9]{20}|\b[0-9a-f]{32}",
    "ipv6": r"[0-9A-Fa-f]:",
    **{kind: "[0-9]" for kind in ("iban", "card", "ip", "born", "ssn", "phone", "address")},
    "name": rf"\b(?=[\p{{Lu}}г]){_TITLES}\.? \p{{Lu}}|\b(?=\p{{Lu}})(?:{_GIVEN}) \p{{Lu}}|(?=\p{{Lu}})(?<=\b{_CUES} )\p{{Lu}}",
}
_HINT = "|".join(dict.fromkeys(HINTS.values()))

#: Classes within which a character is moved.
CLASSES = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "áéíóúàèùâêîôûäöü", "ÁÉÍÓÚÀÈÙÂÊÎÔÛÄÖÜ"]
_HEX = ["0123456789abcdef"]
#: In secrets, letters that hexadecimal numbers have keep to themselves, so that no other secret becomes such a number.
_SECRET = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
#: Calling codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Other keys to try, should the check find a collision.
KEYS = 8
LEAST_KEY = 16
#: Rounds of the network, and numbers that one HMAC gives.
ROUNDS, PER_BLOCK = 4, 16
#: Steps at most from a barred value to one that isn't; should they not be enough, the check finds it.
WALK = 32


def _others() -> list[str]:
    """Classes of the cased letters that CLASSES leaves out, by script and case; scripts with a single one go together."""
    listed, found = set("".join(CLASSES)), defaultdict(str)
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) in ("Lu", "Lt", "Ll") and c not in listed:
            found[unicodedata.category(c) == "Ll", unicodedata.name(c).split()[0]] += c
    single = ["".join(c for (low, _), c in found.items() if low == lower and len(c) == 1) for lower in (False, True)]
    return [c for c in [*found.values(), *single] if len(c) > 1]


def _table(classes: list[str]) -> tuple[str, str, list[int], list[int]]:
    """The letters of all classes in a row, for each a sign of its class (from "!" on), and where each class begins (from 1) and its size.

    An array of a number for each letter would be a large literal, of which every plan's text has a copy; the driver keeps and sends these texts.
    """
    begins = [1 + sum(map(len, classes[:k])) for k in range(len(classes))]
    return "".join(classes), "".join(chr(33 + k) * len(c) for k, c in enumerate(classes)), begins, [len(c) for c in classes]


_LETTERS = _table(CLASSES + _others())
_TABLES = {"letters": _LETTERS, "hex": _table(_HEX), "secret": _table(_SECRET)}


def _with(value: Column, f) -> Column:
    """`f` of a value that is worked out once, however often `f` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _constant(values, kind: str) -> Column:
    """An array of constants that is a single literal once the plan is optimized."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def key_bytes(key: str | bytes | None) -> bytes:
    raw = key.encode() if isinstance(key, str) else bytes(key or b"")
    if len(raw) < LEAST_KEY:
        raise ValueError(f"a secret key of at least {LEAST_KEY} bytes is needed")
    return raw


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as 64 hexadecimal digits."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def _numbers(key: bytes, tweak: Column, k: Column, half: Column, n: Column) -> Column:
    """`n` keyed numbers of 16 bits that depend on the tweak, the round and a half's numbers."""
    digest = hmac_hex(key, F.concat_ws("|", tweak, k.cast("string"), F.array_join(half.cast("array<string>"), ",")))
    blocks = _with(digest, lambda d: F.when(n <= PER_BLOCK, F.array(d)).otherwise(F.transform(F.sequence(F.lit(1), F.ceil(n / PER_BLOCK).cast("int")), lambda j: hmac_hex(key, F.concat_ws("|", d, j.cast("string"))))))
    of_block = lambda h: F.transform(F.sequence(F.lit(0), F.lit(PER_BLOCK - 1)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.slice(F.flatten(F.transform(blocks, of_block)), F.lit(1), n)


def _added(x: Column, f: Column, sizes: Column, way: Column) -> Column:
    return F.zip_with(F.zip_with(x, f, lambda a, b: a + way * b), sizes, lambda s, m: F.pmod(s, m))


def permuted_numbers(numbers: Column, sizes: Column, key: bytes, tweak: Column) -> Column:
    """A keyed bijection of numbers below their sizes (arrays of int) that leaves no array as it is, unless all sizes are 1."""
    n = F.size(numbers)
    cut = F.floor(n / 2).cast("int")
    given = F.struct(
        F.slice(numbers, F.lit(1), cut).alias("a"),
        F.slice(numbers, cut + 1, n - cut).alias("b"),
        F.slice(sizes, F.lit(1), cut).alias("of_a"),
        F.slice(sizes, cut + 1, n - cut).alias("of_b"),
        (F.array_position(F.transform(sizes, lambda m: m > 1), F.lit(True)).cast("int") - 1).alias("first"),
        F.concat_ws("|", tweak, F.array_join(sizes.cast("array<string>"), ",")).alias("tweak"),
    )

    def moved(half, of, before, first, h):
        """The first number that can move goes 1 to its size - 1 places on."""
        return F.transform(half, lambda v, i: F.when(i + before == first, F.pmod(v + 1 + F.pmod(h, F.get(of, i) - 1), F.get(of, i))).otherwise(v))

    def run(g):
        def step(s, k):
            # Odd rounds add to the second half what the first gives, even ones the other way round.
            odd = F.abs(k) % 2 == 1
            source, half, of = (F.when(odd, x).otherwise(y) for x, y in ((s["a"], s["b"]), (s["b"], s["a"]), (g["of_b"], g["of_a"])))
            new = _added(half, _numbers(key, g["tweak"], F.abs(k), source, F.size(half)), of, F.signum(k).cast("int"))
            turned = _with(F.when(F.size(half) > 0, new).otherwise(half), lambda x: F.struct(F.when(odd, s["a"]).otherwise(x).alias("a"), F.when(odd, x).otherwise(s["b"]).alias("b")))
            h = F.conv(F.substring(hmac_hex(key, g["tweak"]), 1, 7), 16, 10).cast("int")
            shift = F.struct(moved(s["a"], g["of_a"], F.lit(0), g["first"], h).alias("a"), moved(s["b"], g["of_b"], F.size(s["a"]), g["first"], h).alias("b"))
            return F.when(k == 0, shift).otherwise(turned)

        order = [*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)]
        done = F.aggregate(_constant(order, "int"), F.struct(g["a"].alias("a"), g["b"].alias("b")), step, lambda s: F.concat(s["a"], s["b"]))
        return F.when(g["first"] >= 0, done).otherwise(F.concat(g["a"], g["b"]))

    return _with(given, run)


def _places(chars: Column, letters: Column) -> Column:
    return F.transform(chars, lambda ch: F.when(F.char_length(ch) == 1, F.instr(letters, ch)).otherwise(0))


def permuted(value: Column, key: bytes, salt: Column, table: Column | str = "letters") -> Column:
    """A bijection of texts with the same classes of characters in the same places, which leaves none as it is.

    `table` names the classes (_TABLES).
    """
    name = F.lit(table) if isinstance(table, str) else table
    only = [table] if isinstance(table, str) else list(_TABLES)

    def choice(f):
        out = f(_TABLES[only[0]])
        for t in only[1:]:
            out = F.when(name == t, f(_TABLES[t])).otherwise(out)
        return out

    begins, sizes = choice(lambda t: _constant(t[2], "int")), choice(lambda t: _constant(t[3], "int"))
    given = F.struct(F.split(value, "").alias("chars"), choice(lambda t: F.lit(t[0])).alias("letters"), choice(lambda t: F.lit(t[1])).alias("kinds"))

    def of_places(c, at):
        kinds = F.transform(at, lambda i: F.when(i > 0, F.ascii(F.substring(c["kinds"], i, F.lit(1))) - 32).otherwise(0))
        return _with(kinds, lambda kinds: of_kinds(c, at, kinds))

    def of_kinds(c, at, kinds):
        own = F.transform(kinds, lambda k: F.when(k > 0, F.element_at(sizes, k)).otherwise(1))
        base = F.transform(kinds, lambda k: F.when(k > 0, F.element_at(begins, k)).otherwise(0))
        return _with(F.struct(own.alias("own"), base.alias("base")), lambda s: of_classes(c, at, s))

    def of_classes(c, at, s):
        x = F.zip_with(at, s["base"], lambda i, b: i - b)
        place = F.zip_with(s["base"], permuted_numbers(x, s["own"], key, salt), lambda b, v: F.when(b > 0, b + v).otherwise(0))
        return F.array_join(F.zip_with(c["chars"], place, lambda ch, p: F.when(p > 0, F.substring(c["letters"], p, F.lit(1))).otherwise(ch)), "")

    return _with(given, lambda c: _with(_places(c["chars"], c["letters"]), lambda at: of_places(c, at)))


def _walked(value: Column, times: int, barred, step) -> Column:
    """`value` after one step, and further ones as long as it is barred: a bijection of what is not barred, if `step` is one."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), value, lambda v, k: F.when((k == 1) | barred(v), step(v)).otherwise(v))


def _luhn(digits: Column) -> Column:
    """The check digit for the digits (an array of text digits, check digit left out)."""
    n = F.size(digits)
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.element_at(_constant((0, 2, 4, 6, 8, 1, 3, 5, 7, 9), "int"), d.cast("int") + 1)).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d
    )
    return (10 - total % 10) % 10


def _into(value: Column, chars: Column, place: str = "^[0-9]$") -> Column:
    """`value` (of a bounded length) with its characters that fit `place` replaced in turn by those of `chars`, all else as it was."""
    done = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, ch: F.when(ch.rlike(place), F.struct(F.concat(a["out"], F.substring(chars, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], ch).alias("out"), a["at"].alias("at"))),
    )
    return done["out"]


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        # Look-behinds see no text before the entity here; the alternatives' order is that of the scan.
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _listed(name: Column, key: bytes) -> Column:
    """A listed name's successor in a keyed rotation of its list, else null."""
    out, seen = F.lit(None).cast("string"), set()
    for i, names in enumerate(_NAMES):
        own = [n for n in dict.fromkeys(names) if n not in seen]
        seen.update(own)
        turn = int.from_bytes(hashlib.sha256(key + b"list%d" % i).digest()[:8], "big") % (len(own) - 1) + 1
        at = F.array_position(_constant(own, "string"), name)
        out = F.when(at > 0, F.element_at(_constant(own, "string"), ((at - 1 + turn) % len(own) + 1).cast("int"))).otherwise(out)
    return out


_ALL_NAMES = list(dict.fromkeys(n for names in _NAMES for n in names))
_SECRET_PREFIX = r"^((?:(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)|AKIA|gh[pousr]_|sk-)"
_BORN_PREFIX = rf"^({_BORN}:? )"


def name_word(word: Column, key: bytes) -> Column:
    """The replacement of one word of a name; a possessive ending stays."""
    base = F.regexp_replace(word, r"['’]s?$", "")
    # No other word becomes a listed name.
    new = _with(base, lambda w: F.coalesce(_listed(w, key), _walked(w, WALK, lambda v: F.array_contains(_constant(_ALL_NAMES, "string"), v), lambda v: permuted(v, key, F.lit("name")))))
    return F.concat(new, F.regexp_extract(word, r"(['’]s?)?$", 0))


def surrogate(entity: Column, key: bytes) -> Column:
    """The replacement of an entity's text."""
    return _with(kind_of(entity), lambda kind: F.when(kind == "name", _name(entity, key)).when(kind.isin("ip", "born"), _of_numbers(entity, kind, key)).otherwise(_of_text(entity, kind, key)))


def _name(entity: Column, key: bytes) -> Column:
    # Only the first word is a title.
    word = lambda w, i: F.when((i == 0) & F.regexp_replace(w, r"\.$", "").rlike(f"^{_TITLES}$"), w).otherwise(name_word(w, key))
    return F.array_join(F.transform(F.split(entity, " "), word), " ")


def _of_text(entity: Column, kind: Column, key: bytes) -> Column:
    """What stays before and behind an entity, and between them what tells it apart, permuted and in its format."""
    no_blanks = F.regexp_replace(entity, r"[ \-]", "")
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    country = F.when(entity.startswith("+"), F.regexp_extract(digits, _COUNTRY, 1)).otherwise("")
    before = F.when(kind == "secret", F.regexp_extract(entity, _SECRET_PREFIX, 1)).when(kind == "iban", F.substring(entity, 1, 2)).when(kind == "phone", country).otherwise("")
    # An email's case doesn't tell persons apart; its last label stays, as the kind of a street does.
    behind = F.when(kind == "email", F.regexp_extract(entity, r"(\.[^.]*)$", 1)).when(kind == "address", F.regexp_extract(entity, r"( [^ ]*)$", 1)).when(kind == "card", F.substring(digits, -1, 1)).otherwise("")
    plain = F.when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind.isin("iban", "ssn"), no_blanks).when(kind.isin("card", "phone"), digits).otherwise(entity)
    parts = F.struct(before.alias("before"), behind.alias("behind"), plain.alias("plain"))

    def of_parts(p):
        value = F.substring(p["plain"], F.char_length(p["before"]) + 1, F.char_length(p["plain"]) - F.char_length(p["before"]) - F.char_length(p["behind"]))
        return _with(value, lambda v: _with(permuted(v, key, salt(p), table(v)), lambda new: form(p, v, new)))

    salt = lambda p: F.concat(kind, F.when(kind == "email", F.lower(p["behind"])).when(kind.isin("phone", "iban"), p["before"]).otherwise(""))
    table = lambda v: F.when((kind == "ipv6") | ((kind == "secret") & v.rlike("^[0-9a-f]+$")), "hex").when(kind == "secret", "secret").otherwise("letters")

    def form(p, old, new):
        # A card's check digit is as right or wrong as it was.
        last = F.pmod(p["behind"].cast("int") - _luhn(F.split(old, "")) + _luhn(F.split(new, "")), F.lit(10)).cast("string")
        chars = F.when(kind == "card", F.concat(new, last)).otherwise(F.concat(p["before"], new, p["behind"]))
        return F.when(kind.isin("card", "phone"), _into(entity, chars)).when(kind.isin("iban", "ssn"), _into(entity, chars, r"^[^ \-]$")).otherwise(chars)

    return _with(parts, of_parts)


def _of_numbers(entity: Column, kind: Column, key: bytes) -> Column:
    """Addresses of version 4, whose first number stays one of those in use (1 to 223), and dates: each number changes within the range in which
    the date is surely valid (12 months, the days from 13 to 28, a year's century)."""
    prefix = F.regexp_extract(entity, _BORN_PREFIX, 1)
    rest = F.substring(entity, F.char_length(prefix) + 1, F.char_length(entity))

    def ranged(text, i):
        n = text.cast("int")
        ip = F.when(i > 0, F.struct(F.lit(0).alias("low"), F.lit(256).alias("size"))).when(n.between(1, 223), F.struct(F.lit(1).alias("low"), F.lit(223).alias("size")))
        date = F.when(F.char_length(text) == 4, F.struct((n - n % 100).alias("low"), F.lit(100).alias("size"))).when(n.between(1, 12), F.struct(F.lit(1).alias("low"), F.lit(12).alias("size"))).when(n.between(13, 28), F.struct(F.lit(13).alias("low"), F.lit(16).alias("size")))
        own = F.coalesce(F.when(kind == "ip", ip).otherwise(date), F.struct(n.alias("low"), F.lit(1).alias("size")))
        return _with(own, lambda r: F.struct(r["low"].alias("low"), r["size"].alias("size"), (n - r["low"]).alias("x"), F.char_length(text).alias("width")))

    def written(numbers):
        new = permuted_numbers(F.transform(numbers, lambda r: r["x"]), F.transform(numbers, lambda r: r["size"]), key, kind)
        # A date's numbers get two digits, so that a day has one form.
        text = lambda r, v: F.when(kind == "ip", (r["low"] + v).cast("string")).otherwise(F.lpad((r["low"] + v).cast("string"), F.greatest(r["width"], F.lit(2)), F.lit("0")))
        mark = F.when(kind == "ip", ".").otherwise(F.regexp_extract(rest, r"\d([./\-])\d", 1))
        return F.concat(prefix, _with(F.zip_with(numbers, new, text), lambda t: F.array_join(F.transform(t, lambda x, i: F.when(i > 0, F.concat(mark, x)).otherwise(x)), "")))

    return _with(F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+)"), F.lit(1)), ranged), written)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `found`: the entities of its text in order; an empty array for none."""
    none = F.array().cast("array<string>")
    scan = F.regexp_extract_all(F.col(text), F.lit(f"({ENTITY})"), F.lit(0))
    return docs.withColumn("found", F.when(F.col(text).rlike(_HINT), scan).otherwise(none))


def name_words(found: Column) -> Column:
    """The words of the names among entities, by which persons may be mentioned again."""
    of_name = lambda e: F.filter(F.transform(F.split(e, " "), lambda w: F.regexp_replace(w, r"['’]s?$", "")), lambda w: w.rlike(r"^\p{Lu}\p{L}{2}") & ~w.rlike(f"^{_TITLES}$"))
    is_name = lambda e: ~e.rlike(r"[0-9@]") & e.rlike(r" \p{Lu}") & (kind_of(e) == "name")
    return F.array_distinct(F.flatten(F.transform(F.filter(found, is_name), of_name)))


@lru_cache(maxsize=1)
def _made(key: bytes, application: str) -> Column:
    """Of `found` and `names`: the replacement, and whether there is one, of each entity. The expression is large, so it is built once for a key."""
    named = F.size("names") > 0
    again = lambda e: F.array_contains(F.col("names"), F.regexp_replace(e, r"['’]s?$", ""))
    bare = lambda e: named & e.rlike(_BARE) & ~e.startswith("AKIA")
    # A bare word is a name of one word to surrogate().
    new = lambda e: F.when(~bare(e) | again(e), surrogate(e, key))
    return F.transform("found", new)


def _application(docs: DataFrame) -> str:
    return docs.sparkSession.sparkContext.applicationId


def replace(docs: DataFrame, key: str | bytes | None) -> DataFrame:
    """`docs` with its text rewritten, and n_entities; other columns stay as they are. `key` is the caller's secret."""
    own = free_key(docs, key_bytes(key))
    rows = entities(docs.select(F.struct("*").alias("row"), F.col("text")))
    rows = rows.withColumn("names", name_words(F.col("found")))
    named = F.size("names") > 0
    rows = rows.withColumn("found", F.when(named, F.regexp_extract_all("text", F.lit(f"({MENTION})"), F.lit(0))).otherwise(F.col("found")))
    rows = rows.withColumn("made", _made(own, _application(docs)))
    new = F.zip_with("found", "made", lambda e, m: F.coalesce(m, e))
    between = F.when(named, F.split(F.col("text"), MENTION, -1)).otherwise(F.split(F.col("text"), ENTITY, -1))
    text = F.when(F.size("found") > 0, F.concat(F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), ""))).otherwise(F.col("text"))
    taken = [F.col(f"row.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns if c != "n_entities"]
    return rows.select(*taken, F.size(F.array_compact("made")).cast("long").alias("n_entities"))


def free_key(docs: DataFrame, key: bytes) -> bytes:
    """The first of `key` and the keys after it whose surrogates have no collisions in the corpus."""
    for k in range(KEYS):
        tried = key + b"#%d" % k if k else key
        if collisions(docs, tried).isEmpty():
            return tried
    raise ValueError(f"surrogates collide for each of {KEYS} keys")


def normal(kind: Column, entity: Column) -> Column:
    """What tells entities of a type apart."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "ssn", F.regexp_replace(entity, r"[ \-]", ""))
        .when(kind == "card", digits)
        .when(kind == "born", F.regexp_replace(F.regexp_replace(entity, _BORN_PREFIX, ""), r"\b(\d)\b", "0$1"))
        .when(kind == "phone", F.concat(F.regexp_extract(entity, r"^(\+?)", 1), digits))
        .otherwise(entity)
    )


def collisions(docs: DataFrame, key: str | bytes) -> DataFrame:
    """kind, surrogate and n_entities of every surrogate that two different entities share or that equals its entity."""
    own = key_bytes(key)
    distinct = entities(docs.select("text")).select(F.explode("found").alias("entity")).distinct()
    made = distinct.withColumn("found", F.array("entity")).withColumn("names", F.array().cast("array<string>")).withColumn("made", _made(own, _application(docs)))
    made = made.select("entity", kind_of(F.col("entity")).alias("kind"), F.element_at("made", 1).alias("surrogate"))
    made = made.select("kind", normal(F.col("kind"), F.col("entity")).alias("entity"), normal(F.col("kind"), F.col("surrogate")).alias("surrogate"))
    # What is replaced of an entity: not an email's last label, nor the word before a secret.
    replaced = F.when(F.col("kind") == "email", F.regexp_extract("entity", r"^(.*)\.[^.]*$", 1)).when(F.col("kind") == "secret", F.regexp_replace("entity", _SECRET_PREFIX, "")).otherwise(F.col("entity"))
    made = made.distinct().withColumn("same", ((F.col("entity") == F.col("surrogate")) & replaced.rlike(r"[\p{L}\p{N}]")).cast("int"))
    return made.groupBy("kind", "surrogate").agg(F.countDistinct("entity").alias("n_entities"), F.max("same").alias("unchanged")).filter("n_entities > 1 or unchanged = 1")
