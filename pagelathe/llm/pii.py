"""Surrogates for personal data, by DataFrame functions only.

Entities are found by patterns and read into (kind, normal form). Each gets a new normal form drawn from an HMAC of its kind
and normal form, so the same entity has the same surrogate in every document and spelling (coreference). A match is then
written with its own format: separators, letter case and what tells its type stay. Digits stay digits and letters stay
letters of their script; a card that passes the Luhn test and an IBAN that passes its check give ones that do; country,
private and reserved address ranges, top-level domains, key names, token prefixes, titles and the gender they tell stay.
Addresses at one mail domain keep a common domain.

Where a text tells the gender of a person once, a neutral title or a cue before the same name counts as the same person, and
bare mentions of a detected given name or surname anywhere in that text are replaced alike.

Distinct entities must differ afterwards, and no surrogate may be an entity of the corpus: surrogates are checked against
each other and against all entities, and those that clash are drawn again with the next attempt number. Names and other
words grow with the attempt, as do the last groups of IPv6, so there is room for any number of them. Where a fixed format
has no room left, as when a corpus names most of a private range, the entities still without a surrogate exchange theirs in
a ring of their own format, in the order of an HMAC: distinct, of their type, and none stays what it was.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelathe.llm.scratch import BROADCAST_ROWS, discard, sized, written

#: Where op4_pii finds its key; without one it takes DEMO_KEY, under which anyone can draw the same surrogates.
KEY_CONF, DEMO_KEY = "spark.pagelathe.pii.key", "pagelathe-demo-key"
#: Draws end after so many attempts, or when STUCK of them in a row have settled nothing.
MOST_ATTEMPTS, STUCK = 40, 4

# Titles by gender, and titles of either.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
EITHER = ["Dr", "Prof", "Professor", "Doctor"]
# Letters by script, for what is drawn letter by letter.
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz",
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփք",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    "Han": "安白蔡陈成春德方飞高国海华江杰金静康兰雷李丽林龙玲美明宁平强青荣山石松涛天王伟文小星雅阳玉云志",
}
# Syllables and endings of names by script.
SYLLABLES = {
    "Latin": ["ba", "ce", "di", "fo", "ga", "he", "ki", "lo", "ma", "ne", "pi", "ro", "sa", "te", "vi", "zo"],
    "Cyrillic": ["ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо"],
    "Greek": ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"],
}
ENDINGS = {
    "Latin": {"first_f": ["na", "lia", "ra"], "first_m": ["no", "rus", "ton"], "first": ["ri", "sel", "lin"], "surname": ["ler", "man", "sky"], "street": ["field", "ton", "wood"]},
    "Cyrillic": {"first_f": ["на", "лия", "ра"], "first_m": ["р", "слав", "тон"], "first": ["ри", "ль", "ми"], "surname": ["ко", "чук", "ян"], "street": ["ская", "ная", "вая"]},
    "Greek": {"first_f": ["να", "ρια", "λη"], "first_m": ["νος", "ρος", "της"], "first": ["ρι", "λι", "σι"], "surname": ["δης", "πουλος", "κος"], "street": ["νου", "ρων", "κης"]},
}

_EDGE, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Words between given name and surname.
_PARTICLE = r"(?:(?:van|von|de|der|den|del|della|da|di|du|dos|la|le|ten|ter|zu|bin|ibn|al) )"
_KEY = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?"
_WORD = r"(?i:password|passwd|pwd)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?"
_BEARER = r"[Bb]earer {1,2}"
_USER = r"[\p{L}\p{N}._%+-]++:[^\s/@:]++"
_TOKEN = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ)"
_TITLE = rf"(?:{'|'.join(MALE + FEMALE + EITHER)})"
_CUE = r"(?:[Mm]y name is|[Nn]ame:|[Ss]igned,?|[Cc]ontact:|[Dd]ear|[Rr]egards,|[Aa]uthor:|I am|I'm)"
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Square|Straße|Strasse|Weg|Platz)"
_DOES = r"(?: (?:lives|lived|resides|resided|was born|works|worked|can be reached))"
#: Kind, pattern, and the pattern of a match by itself where that differs; tried in this order at a place. Each begins with
#: a test of one character, so that most places fail at once, and none rescans a run of characters.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+", None),
    ("secret", rf"(?=[AgsxeG]){_EDGE}{_TOKEN}[0-9A-Za-z_.-]{{15,}}+", None),
    ("secret", rf"(?=[TtSsPpAaKk]){_EDGE}{_KEY}[0-9A-Za-z_+/-]{{16,}}+=*", None),
    ("secret", rf"(?=[Pp]){_EDGE}{_WORD}(?=[^ \t\n\"',;]*[0-9])[^ \t\n\"',;]{{8,}}+", None),
    ("secret", rf"(?=[Bb]){_EDGE}{_BEARER}[0-9A-Za-z_.~+/-]{{16,}}+=*", None),
    ("ip6", rf"(?=[0-9A-Fa-f:])(?<![\p{{L}}\p{{N}}_:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}_:])", None),
    ("ip", rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}_]|\.[0-9])", None),
    ("secret", rf"(?<=://){_USER}(?=@)", _USER),
    ("iban", rf"(?=[A-Z]){_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_STOP}", None),
    ("ssn", r"(?=[0-9])(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])", None),
    ("phone", rf"(?=\+)(?<![\p{{L}}\p{{N}}_+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?(?!{_OCTET}(?:\.{_OCTET}){{3}})[0-9]{{2,4}}){{1,4}}{_STOP}", None),
    ("phone", rf"(?=[(0-9])(?<![\p{{L}}\p{{N}}_.-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_STOP}", None),
    ("phone", rf"(?=0)(?<![\p{{L}}\p{{N}}_.,-])0[1-9][0-9]{{1,3}}[ /-][0-9]{{5,8}}{_STOP}", None),
    ("card", rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_.])[0-9](?:[ -]?[0-9]){{12,18}}{_STOP}", None),
    ("address", rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_.-])[0-9]{{1,4}}[a-z]? {_NAME} {_STREET}{_STOP}", None),
    ("person", rf"(?=\p{{Lu}}){_EDGE}{_TITLE}\.? {_PARTICLE}{{0,3}}{_NAME}(?: {_PARTICLE}{{0,3}}{_NAME})?", None),
    ("person", rf"(?=m){_EDGE}mrs?\.? [a-z]{{2,}}(?: [a-z]{{2,}})?{_STOP}", None),
    ("person", rf"(?=[MmNnSsCcDdRrAaI]){_EDGE}{_CUE}[ \n]{_NAME} {_PARTICLE}{{0,3}}{_NAME}{_STOP}", None),
    ("person", rf"(?=\p{{Lu}}){_EDGE}{_NAME} {_PARTICLE}{{0,3}}{_NAME}(?={_DOES}{_STOP})", rf"{_NAME} {_PARTICLE}{{0,3}}{_NAME}"),
]
#: All of them; none begins within a word, so most places fail at the first test.
ANY = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}:+(._%-])(?:" + "|".join(f"(?:{p})" for _, p, _ in PATTERNS) + ")"
#: A match holds a digit or one of the marks @ = :, or one of these: a text without them is not searched. Plain substrings,
#: since an alternation of so many words is tried at every place of every text.
SIGNS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xox", "AIza", "eyJ", "earer ", "mr ", "mr.", "mrs", "name is", "igned", "Dear ", "Dear\n", "dear ", "dear\n", "egards,", "I am ", "I am\n", "I'm ", "I'm\n", " live", " reside", " was born", " work", " can be reached"]
SIGNS += sorted({t for t in MALE + FEMALE + EITHER if not any(t != o and t.startswith(o) for o in MALE + FEMALE + EITHER)})


def matches(text: Column) -> Column:
    """All matches of ANY in a text, in order. Texts that hold none of what every match must hold are not searched."""
    may = reduce(lambda a, b: a | b, [text.rlike("[0-9@=:]"), *(F.contains(text, F.lit(x)) for x in SIGNS)])
    return F.coalesce(F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), F.array().cast("array<string>"))


def kind_of(raw: Column) -> Column:
    """The kind of a string that ANY has matched: that of the first pattern which takes all of it."""
    tests = [(kind, raw.rlike(f"^(?:{own or pattern})$")) for kind, pattern, own in PATTERNS]
    return reduce(lambda c, x: c.when(x[1], x[0]), tests, F).otherwise("other")


def _lead(raw: Column, kind: Column) -> Column:
    """What stands before a secret's or a person's own part: key name, token prefix, title or cue, and particles after it."""
    secret = F.regexp_extract(raw, rf"^(?:{_WORD}|{_KEY}|{_TOKEN}|{_BEARER})", 0)
    person = F.regexp_extract(raw, rf"^(?:{_TITLE}\.? {_PARTICLE}{{0,3}}|mrs?\.? |{_CUE}[ \n])", 0)
    return F.when(kind == "secret", secret).when(kind == "person", person).otherwise("")


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def _bytes(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """96 numbers below 256: HMAC-SHA256 under the key of kind, normal form, attempt and a counter."""
    inner, outer = _pads(key)

    def one(i: int) -> Column:
        message = F.encode(F.concat_ws("|", kind, norm, attempt.cast("string"), F.lit(str(i))), "UTF-8")
        return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)

    return F.transform(F.regexp_extract_all(F.concat(*map(one, range(3))), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def _at(numbers: Column, i: Column) -> Column:
    return F.element_at(numbers, F.pmod(i, F.lit(96)) + 1)


def _pick(letters: Column | str, n: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, F.pmod(n, F.length(letters)) + 1, F.lit(1))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _draw(s: Column, numbers: Column, keep: Column, latin: Column, digits: Column) -> Column:
    """s with each letter and digit after the first keep characters drawn anew, in its class, script and case; latin and
    digits are what letters a-z and digits are drawn from."""

    def one(c: Column, i: Column) -> Column:
        small, n = F.lower(c), _at(numbers, i)
        drawn = F.when(c.rlike("[0-9]"), _pick(digits, n)).when(small.rlike("[a-z]"), _pick(latin, n))
        drawn = reduce(lambda d, kv: d.when(small.rlike(rf"^\p{{Is{kv[0]}}}"), _pick(kv[1], n)), LETTERS.items(), drawn).otherwise(c)
        return F.when((i >= keep) & c.rlike(r"^[\p{L}\p{N}]"), F.when(c != small, F.upper(drawn)).otherwise(drawn)).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _plain(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))


def _fit(raw: Column, new: Column) -> Column:
    """raw with its letters and digits replaced one by one by those of new, in raw's letter case; what new has more of follows."""

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike(r"^[\p{L}\p{N}]")
        drawn = F.substring(new, acc["i"] + 1, F.lit(1))
        drawn = F.when(c != F.lower(c), F.upper(drawn)).otherwise(drawn)
        return F.struct(F.concat(acc["s"], F.when(counts, drawn).otherwise(c)).alias("s"), (acc["i"] + F.when(counts, 1).otherwise(0)).alias("i"))

    return F.aggregate(_chars(raw), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), step, lambda acc: F.concat(acc["s"], F.substring(new, acc["i"] + 1, F.length(new))))


def _entities(raw: Column, kind: Column, lead: Column) -> Column:
    """Array of (kind, norm) that a match stands for, in the order in which render() takes them."""
    own = F.substring(raw, F.length(lead) + 1, F.length(raw))
    ent = lambda k, n: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), n.alias("norm"))
    names = F.split(own, " ")
    title = F.regexp_extract(lead, r"^\p{L}+", 0)
    first = F.when(title.isin(*FEMALE, "mrs"), "first_f").when(title.isin(*MALE, "mr"), "first_m").otherwise("first")
    last = ent("surname", F.lower(F.element_at(names, -1)))
    person = F.when(F.size(names) > 1, F.array(last, ent(first, F.lower(F.element_at(names, 1))))).otherwise(F.array(last))
    address = F.array(ent("street", F.lower(F.regexp_extract(raw, rf"^\S+ (.*) {_STREET}$", 1))), ent("house", F.lower(raw)))
    number = F.concat(F.when(F.startswith(raw, F.lit("+")), "+").otherwise(""), _plain(raw))
    email = F.array(ent("mail_domain", F.lower(F.substring_index(raw, "@", -1))), ent("mailbox", F.lower(raw)))
    norm = F.when(kind == "secret", own).when(kind.isin("ip", "ip6"), F.lower(raw)).otherwise(number)
    return F.when(kind == "email", email).when(kind == "person", person).when(kind == "address", address).otherwise(F.array(ent(kind, norm)))


def read(found: Column) -> Column:
    """Matches as array of (raw, kind, lead, ents); each step is an array of its own, so nothing is computed twice."""
    kinds = F.transform(found, lambda raw: F.struct(raw.alias("raw"), kind_of(raw).alias("kind")))
    leads = F.transform(kinds, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), _lead(x["raw"], x["kind"]).alias("lead")))
    return F.transform(leads, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), x["lead"].alias("lead"), _entities(x["raw"], x["kind"], x["lead"]).alias("ents")))


def _name(kind: Column, norm: Column, numbers: Column, attempt: Column) -> Column:
    """Three syllables, one more with each attempt, and an ending: the space grows beyond any number of entities."""
    script = reduce(lambda c, s: c.when(norm.rlike(rf"^\p{{Is{s}}}"), s), [s for s in SYLLABLES if s != "Latin"], F).otherwise("Latin")
    lists = lambda found: F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in found for x in kv))
    syllables = F.try_element_at(lists(SYLLABLES.items()), script)
    endings = F.try_element_at(lists((f"{s}:{k}", v) for s, own in ENDINGS.items() for k, v in own.items()), F.concat_ws(":", script, kind))
    drawn = lambda own, i: F.element_at(own, F.pmod(_at(numbers, i), F.size(own)) + 1)
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: drawn(syllables, i)), ""), drawn(endings, F.lit(95)))


def _more(numbers: Column, attempt: Column) -> Column:
    """Letters that a word gets with later attempts, one more every other attempt."""
    n = F.floor(attempt / 2).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(LETTERS["Latin"], _at(numbers, i + 60))), "")).otherwise("")


def _luhn(norm: Column, drawn: Column) -> Column:
    """drawn with its last digit set so that it passes the Luhn test, if norm does."""
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.filter(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.call_function("luhn_check", F.concat(head, d)))
    return F.when(F.call_function("luhn_check", norm), F.concat(head, F.element_at(last, 1))).otherwise(drawn)


def _mod97(s: Column) -> Column:
    """The remainder of an IBAN's letters and digits, the first four moved to the end."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(F.upper(c)) - 55)
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(_chars(turned), F.lit(0), lambda acc, c: F.pmod(F.when(c.rlike("[0-9]"), acc * 10).otherwise(acc * 100) + value(c), F.lit(97)).cast("int"))


def _iban(norm: Column, drawn: Column) -> Column:
    """The country stays; the check digits are right if they were."""
    country, rest = F.substring(norm, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(_mod97(norm) == 1, F.concat(country, check, rest)).otherwise(drawn)


def _ip(norm: Column, numbers: Column) -> Column:
    """Octets; private, loopback and link-local ranges stay, a public address stays public."""
    some = lambda i, least, n: (F.pmod(_at(numbers, F.lit(i)), F.lit(n)) + least).cast("string")
    octets = [some(i, 0 if i < 3 else 1, 255 if i < 3 else 254) for i in range(4)]
    fixed = [("10.", ["10"]), ("127.", ["127"]), ("192.168.", ["192", "168"]), ("169.254.", ["169", "254"])]
    out = F.when(norm.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), some(1, 16, 16), *octets[2:]))
    for prefix, kept in fixed:
        out = out.when(F.startswith(norm, F.lit(prefix)), F.concat_ws(".", *map(F.lit, kept), *octets[len(kept) :]))
    return out.otherwise(F.concat_ws(".", some(0, 11, 111), *octets[1:]))


def drawn_for(kind: Column, norm: Column, numbers: Column, attempt: Column) -> Column:
    """The new normal form of an entity.

    An IPv6 address whose last group is short may get more digits there with later attempts. Of IPv6 the link-local, unique local, multicast and documentation prefixes stay, else the first digit; of a card the
    first digit, of a phone number the first digit of its country or its leading zero.
    """
    box, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(norm, ".", -1)
    named = kind.isin("surname", "first", "first_m", "first_f", "street")
    template = (
        F.when(kind == "mailbox", _plain(box))
        .when(kind == "mail_domain", _plain(F.substring(norm, F.lit(1), F.length(norm) - F.length(tld) - 1)))
        .when(kind == "house", F.substring_index(norm, " ", 1))
        .when(named | (kind == "ip"), "")
        .otherwise(norm)
    )
    range6 = F.when(F.startswith(norm, F.lit("2001:db8")), 8).when(norm.rlike("^f[cdef]"), F.length(F.substring_index(norm, ":", 1))).otherwise(1)
    keep = F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "ip6", range6).when(F.startswith(norm, F.lit("+")), 2).when((kind == "phone") & F.startswith(norm, F.lit("0")), 1).otherwise(0)
    hexadecimal = (kind == "ip6") | ((kind == "secret") & norm.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    latin = F.when(hexadecimal, "abcdef").otherwise(LETTERS["Latin"])
    digits = F.when(kind.isin("ip6", "house"), "123456789").otherwise("0123456789")
    bound = F.transform(F.array(F.struct(template.alias("s"), keep.alias("keep"), latin.alias("latin"), digits.alias("digits"))), lambda t: _draw(t["s"], numbers, t["keep"], t["latin"], t["digits"]))

    # the last group of an IPv6 address has up to four digits; later attempts fill it up
    group = F.length(F.substring_index(norm, ":", -1))
    wider = F.least(4 - group, F.floor(attempt / STUCK).cast("int"))
    suffix = F.when(wider > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wider, F.lit(1))), lambda i: _pick("0123456789abcdef", _at(numbers, i + 70))), "")).otherwise("")

    def finish(drawn: Column) -> Column:
        return (
            F.when(kind == "mailbox", F.concat(drawn, _more(numbers, attempt), F.lit("@"), domain))
            .when(kind == "mail_domain", F.concat(drawn, _more(numbers, attempt), F.lit("."), tld))
            .when(kind == "secret", F.concat(drawn, _more(numbers, attempt)))
            .when(named, _name(kind, norm, numbers, attempt))
            .when(kind == "ip", _ip(norm, numbers))
            .when(kind == "ip6", F.concat(drawn, suffix))
            .when(kind == "iban", _iban(norm, drawn))
            .when(kind == "card", _luhn(norm, drawn))
            .otherwise(drawn)
        )

    return F.element_at(F.transform(bound, finish), 1)


def _cased(like: Column, name: Column) -> Column:
    return F.when(like == F.lower(like), name).when((F.length(like) > 1) & (like == F.upper(like)), F.upper(name)).otherwise(F.initcap(name))


def render(raw: Column, kind: Column, lead: Column, new: Column) -> Column:
    """A match written anew: new has the new normal forms of its entities."""
    own = F.substring(raw, F.length(lead) + 1, F.length(raw))
    names = F.split(own, " ")
    first = lambda i: F.element_at(new, i)
    domain = F.substring_index(raw, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    email = F.concat(_fit(F.substring_index(raw, "@", 1), F.substring_index(first(2), "@", 1)), F.lit("@"), _fit(F.substring(domain, F.lit(1), F.length(domain) - F.length(tld) - 1), F.substring_index(first(1), ".", 1)), F.lit("."), tld)
    between = F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0))), " ")  # particles stay
    given = F.concat(_cased(F.element_at(names, 1), F.try_element_at(new, F.lit(2))), F.lit(" "), F.when(between != "", F.concat(between, F.lit(" "))).otherwise(""))
    person = F.concat(lead, F.when(F.size(names) > 1, given).otherwise(""), _cased(F.element_at(names, -1), first(1)))
    address = F.concat_ws(" ", F.try_element_at(new, F.lit(2)), F.initcap(first(1)), F.regexp_extract(raw, rf"{_STREET}$", 0))
    return (
        F.when(kind == "email", email)
        .when(kind == "person", person)
        .when(kind == "address", address)
        .when(kind == "secret", F.concat(lead, first(1)))
        .when(kind == "ip", first(1))
        .when(kind == "ip6", _fit(raw, _plain(first(1))))
        .otherwise(_fit(raw, _plain(first(1))))
    )


def shape(kind: Column, norm: Column) -> Column:
    """What entities of one format have in common, within which surrogates may be exchanged."""
    ranges = reduce(lambda c, p: c.when(norm.rlike(p), p), [r"^10\.", r"^127\.", r"^192\.168\.", r"^169\.254\.", r"^172\.(?:1[6-9]|2[0-9]|3[01])\."], F).otherwise("public")
    same = F.regexp_replace(F.regexp_replace(norm, "[0-9]", "0"), "[a-z]", "a")
    hexadecimal = F.concat(F.when(norm.rlike("^f[cdef]|^2001:db8"), F.substring(norm, 1, 4)).otherwise(""), F.regexp_replace(norm, "[0-9a-f]", "0"))
    return F.when(kind == "ip", ranges).when(kind == "ip6", hexadecimal).when(kind == "iban", F.concat(F.substring(norm, 1, 2), same)).when(kind == "card", F.concat(F.substring(norm, 1, 1), same)).when(kind == "phone", F.concat(F.substring(norm, 1, 2), same)).otherwise(same)


def ring(left: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(kind, norm, drawn) for entities left without a surrogate: the next of them in their format, by the order of an HMAC.

    The only one left of a format takes another entity of that format, which no one else has as a surrogate; where there is
    none, its format has one value, and it gets a digit more.
    """
    turn = F.array_join(_bytes(key, F.col("kind"), F.col("norm"), F.lit(-1)), ",")
    own = left.select("kind", "norm", shape(F.col("kind"), F.col("norm")).alias("shape"), turn.alias("turn"))
    at = Window.partitionBy("kind", "shape").orderBy("turn", "norm")
    whole = Window.partitionBy("kind", "shape")
    own = own.withColumn("next", F.coalesce(F.lead("norm").over(at), F.min_by("norm", F.struct("turn", "norm")).over(whole))).withColumn("n", F.count("*").over(whole))
    alone = own.where("n = 1").select("kind", "shape", "norm")
    others = known.select("kind", F.col("norm").alias("other"), shape(F.col("kind"), F.col("norm")).alias("shape"))
    taken = alone.join(others, ["kind", "shape"], "left").groupBy("kind", "norm").agg(F.min(F.when(F.col("other") != F.col("norm"), F.col("other"))).alias("other"))
    longer = F.concat("norm", F.element_at(_bytes(key, F.col("kind"), F.col("norm"), F.lit(-2)), 1).cast("string").substr(1, 1))
    return own.where("n > 1").select("kind", "norm", F.col("next").alias("drawn")).unionByName(taken.select("kind", "norm", F.coalesce("other", longer).alias("drawn")))


def linked(matched: Column) -> Column:
    """read() matches of one text with a given name after a neutral title or a cue counted as that of the gender which the text
    gives the same full name elsewhere, if it gives one."""
    full = lambda x: (x["kind"] == "person") & (F.size(x["ents"]) == 2)
    gendered = F.array_distinct(F.transform(F.filter(matched, lambda x: full(x) & (x["ents"][1]["kind"] != "first")), lambda x: x["ents"]))

    def one(x: Column, told: Column) -> Column:
        same = F.filter(told, lambda e: (e[0]["norm"] == x["ents"][0]["norm"]) & (e[1]["norm"] == x["ents"][1]["norm"]))
        ents = F.when(full(x) & (x["ents"][1]["kind"] == "first") & (F.size(same) == 1), same[0]).otherwise(x["ents"])
        return F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), x["lead"].alias("lead"), ents.alias("ents"))

    return F.when(F.size(gendered) > 0, F.transform(matched, lambda x: one(x, gendered))).otherwise(matched)


def _new(kind: Column, norm: Column, key: str, settled) -> Column:
    """An entity's surrogate: what settled(kind, norm) gives, else the first draw."""
    bound = F.transform(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), _bytes(key, kind, norm, F.lit(0)).alias("n"))), lambda e: drawn_for(e["kind"], e["norm"], e["n"], F.lit(0)))
    return F.coalesce(settled(kind, norm), bound[0])


def surrogates(matched: Column, key: str, settled) -> Column:
    """The replacements of read() matches, in order; settled(kind, norm) gives the surrogate of an entity that has been drawn
    again, null of others."""
    fresh = F.transform(matched, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), x["lead"].alias("lead"), F.transform(x["ents"], lambda e: _new(e["kind"], e["norm"], key, settled)).alias("new")))
    return F.transform(fresh, lambda x: render(x["raw"], x["kind"], x["lead"], x["new"]))


def mentions(matched: Column, key: str, settled) -> Column:
    """Array of (word, new): the capitalised given names and surnames of the persons among read() matches and what stands for
    them elsewhere in the text; of a word that names several the first counts."""

    def one(x: Column) -> Column:
        words = F.split(F.substring(x["raw"], F.length(x["lead"]) + 1, F.length(x["raw"])), " ")
        entry = lambda word, e: F.struct(word.alias("word"), e["kind"].alias("kind"), e["norm"].alias("norm"))
        last = entry(F.element_at(words, -1), x["ents"][0])
        return F.when(F.size(x["ents"]) == 2, F.array(last, entry(F.element_at(words, 1), x["ents"][1]))).otherwise(F.array(last))

    named = F.array_distinct(F.flatten(F.transform(F.filter(matched, lambda x: x["kind"] == "person"), one)))
    named = F.filter(named, lambda w: w["word"].rlike(r"^\p{Lu}.*\p{L}"))
    return F.transform(named, lambda w: F.struct(w["word"].alias("word"), _cased(w["word"], _new(w["kind"], w["norm"], key, settled)).alias("new")))


def replace_mentions(gap: Column, named: Column) -> Column:
    """gap with each word of named, standing alone, replaced. The words are letters, apostrophes and hyphens only."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_@.-])(?:"), F.array_join(F.transform(named, lambda w: w["word"]), "|"), F.lit(r")(?![\p{L}\p{N}_@-])"))
    fresh = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda word: F.filter(named, lambda w: w["word"] == word)[0]["new"])
    return F.array_join(F.zip_with(F.split(gap, pattern, -1), F.concat(fresh, F.array(F.lit(""))), lambda rest, new: F.concat(rest, new)), "")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with its entities replaced, n_entities, kinds (sorted array).

    Texts without entities are returned as they are, null as null with n_entities 0. Null and repeated ids change
    nothing. An empty table gives an empty result; other columns are not read. Names without a title are found after a
    cue ("my name is", "dear") or before one ("lives", "was born"); their given names count as other entities than those
    after a title that tells a gender, unless their text tells it; surnames are the same. Bare mentions of a person's names
    in the same text are replaced, too, and not counted.

    Entities are made distinct in each task before the shuffle, so one that stands in a third of all texts costs a row
    a task. Texts are not shuffled unless some replacement had to be drawn again; then only to add those few.
    """
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), matches(F.col(text_col)).alias("m"))
    seen = found.where(F.size("m") > 0).select(F.explode(F.array_distinct("m")).alias("raw")).distinct()
    known = written(seen.select(F.explode(read(F.array("raw"))[0]["ents"]).alias("e")).select("e.kind", "e.norm").distinct(), "entities")

    def drawn(df: DataFrame) -> DataFrame:
        """df with the normal form that each entity is replaced by at its attempt."""
        keyed = df.withColumn("n", _bytes(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        return keyed.select("kind", "norm", "attempt", drawn_for(F.col("kind"), F.col("norm"), F.col("n"), F.col("attempt")).alias("drawn"))

    # houses differ by their street, which has been replaced; their numbers need not differ
    state = written(drawn(known.where("kind <> 'house'").withColumn("attempt", F.lit(0))), "drawn")
    real = known.select("kind", F.col("norm").alias("drawn"), F.lit(True).alias("real"))
    stuck, least = 0, None
    for round_ in range(MOST_ATTEMPTS + 1):
        order = F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("attempt", "norm"))
        checked = state.withColumn("nth", order).join(real, ["kind", "drawn"], "left")
        checked = written(checked.withColumn("clash", F.col("real").isNotNull() | (F.col("nth") > 1)), "checked")
        n_left = checked.where("clash").count()
        if not n_left:
            discard(checked)
            break
        stuck = 0 if least is None or n_left < least else stuck + 1
        least = n_left if least is None else min(least, n_left)
        fine = checked.where("NOT clash").select("kind", "norm", "attempt", "drawn")
        clashing = checked.where("clash")
        # a format whose last group can still grow is not full yet
        over = round_ == MOST_ATTEMPTS or (stuck >= STUCK and round_ >= 4 * STUCK)
        if over:
            after = written(fine.unionByName(ring(clashing, known, key).withColumn("attempt", F.lit(round_ + 1))), "drawn")
        else:
            after = written(fine.unionByName(drawn(clashing.withColumn("attempt", F.col("attempt") + 1))), "drawn")
        discard(state)
        discard(checked)
        state = after
        if over:
            break
    again = state.where("attempt > 0").select(F.concat_ws(":", "kind", "norm").alias("entity"), "drawn")
    n_again = again.count()
    found = found.withColumn("x", linked(read(F.col("m"))))
    if not n_again:
        settled = lambda *_: F.lit(None).cast("string")
        out = found
    else:
        settled = lambda kind, norm: F.try_element_at("again", F.concat_ws(":", kind, norm))
        again = sized(again, n_again, BROADCAST_ROWS // 4)
        of = found.where(F.size("m") > 0).select(F.sha2("text", 256).alias("sha"), F.explode(F.flatten(F.transform("x", lambda x: x["ents"]))).alias("e"))
        of = of.select("sha", F.concat_ws(":", "e.kind", "e.norm").alias("entity")).distinct().join(again, "entity")
        maps = of.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("entity", "drawn"))).alias("again"))
        out = found.withColumn("sha", F.sha2("text", 256)).join(maps, "sha", "left")
    out = out.withColumn("named", mentions(F.col("x"), key, settled))
    fresh = F.concat(surrogates(F.col("x"), key, settled), F.array(F.lit("")))
    gaps = F.split("text", ANY, -1)
    gaps = F.when(F.size("named") > 0, F.transform(gaps, lambda gap: replace_mentions(gap, F.col("named")))).otherwise(gaps)
    text = F.array_join(F.zip_with(gaps, fresh, lambda gap, new: F.concat(gap, new)), "")
    kinds = F.array_sort(F.array_distinct(F.transform("x", lambda x: x["kind"])))
    some = F.size("m") > 0
    return out.select(F.col("id").alias(id_col), F.when(some, text).otherwise(F.col("text")).alias(text_col), F.size("m").alias("n_entities"), F.when(some, kinds).otherwise(F.array().cast("array<string>")).alias("kinds"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, under the key that the session names."""
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=spark.conf.get(KEY_CONF, DEMO_KEY))
