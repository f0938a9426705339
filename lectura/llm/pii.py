"""Personal data replaced by keyed surrogates of the same type and format.

Found are: e-mail addresses, IBANs, secrets (after words like token or key, well-known prefixes, long hex strings), IPv4
addresses, card numbers, US social security numbers, phone numbers, and persons (a title with a name, or a known given
name with a surname; then every further mention of those names in the text).

A surrogate comes from a permutation that is keyed by `key` (the caller's secret) and the entity's type and format.
Characters keep their class (digit, vowel or consonant, case, script), separators stay, and given names become given
names of the same gender and script; the gender is the name's own, else the one that its title tells. With P a keyed
Feistel permutation over all values of a format, v becomes P^-1(P(v) + 1): one cycle through all values, so no two
entities share a surrogate, none is its own, and equal entities are replaced alike in all documents without any table.
A listed given name gets one of the surrogate
names of its gender and script (`pool`, made by a rule, apart from the listed ones), a name that is not listed is spelled
anew letter by letter, and where a title tells its gender a surrogate name stands before that. So a name's spelled part
is the same wherever it stands. Card numbers keep whether their check digit holds, IBANs get a valid one, addresses stay
in public or private space.

Surrogates depend on key and entity alone, so they agree across documents. Only where two entities of one document would
get the same one (formats that meet in a spelling), or one would get another's original, does the later one go on along
its cycle until it is free, and if its cycle has no free value, letters are added.

Defined results: null texts stay null without entities, empty ones empty; texts are read whole, whatever their length;
repeated rows get equal results; other columns pass through `replace_private` untouched, also those with the names used
inside (one named like `entities` is replaced by it); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, slices

#: Given names by (gender, script), surnames by script; each list is a pool of surrogates of its own.
GIVEN = {
    ("m", "Latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Karl Jürgen Wolfgang Pierre Jean Michel André Carlos José Juan Miguel Antonio".split(),
    ("f", "Latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Laura Ursula Monika Sabine Marie Sophie Camille Hélène Carmen Lucía María Isabel Elena".split(),
    ("m", "Cyrillic"): "Иван Сергей Дмитрий Алексей Андрей Николай Михаил Павел Олег Виктор".split(),
    ("f", "Cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
    ("m", "Greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
    ("f", "Greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
#: Titles and the gender they tell ("" for none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}

#: Classes of characters; a character becomes one of its own class.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áàâäãåéèêëíìîïóòôöõúùûü", "çñß", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "ÇÑ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς", "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "āăąēėęěīįıōőūůűųý", "ćčďđğģķĺļľłńņňŕřśşšťţůźżž", "ĀĂĄĒĖĘĚĪĮİŌŐŪŮŰŲÝ", "ĆČĎĐĞĢĶĹĻĽŁŃŅŇŔŘŚŞŠŤŢŹŻŽ",
]
#: Han characters of names become others of this list; a character outside it stays.
HAN = "明华强伟芳丽敏静军杰勇艳涛磊洋娟秀英文玉兰平刚桂辉玲红春梅建国志海燕云峰林龙飞鹏宇浩天欣怡佳琪雪婷小大王李张刘陈杨黄赵吴周徐孙马朱胡郭何高罗郑梁谢宋唐许韩冯邓曹彭曾"
CLASSES.append("".join(dict.fromkeys(HAN)))
HEX = ("0123456789abcdef", "0123456789ABCDEF")
#: Surrogate given names: each stem with each ending.
STEMS = {
    "Latin": "Al Ber Cor Dan El Fer Gal Han Is Jul Kar Lor Mar Nor Ol Per Ros Sev Tan Val Wil Yor Zan Bel Cel Dor Em Fil Ger Hel".split(),
    "Cyrillic": "Ал Бор Вал Гор Дар Ел Зор Ил Кир Лор Мил Нор Ол Пав Рад Сев Тар Юл".split(),
    "Greek": "Αλ Βασ Γερ Δημ Ελ Ζην Ηρ Θεοδ Ιλ Κλε Λεων Μελ Νικ Ξεν Ολ Πολ".split(),
}
ENDINGS = {
    ("f", "Latin"): "ela ina etta isa ora anna elle ia ena ica ola une".split(), ("m", "Latin"): "on ert ius ard ian ric mond win olf ek is en".split(),
    ("f", "Cyrillic"): "ина ея ана ида ора ия ета уша".split(), ("m", "Cyrillic"): "ан ей ир он ислав ик им ур".split(),
    ("f", "Greek"): "ία ώ ίνα ούλα άνθη ίκη".split(), ("m", "Greek"): "ος ης ίας ων ίων άκης".split(),
}
_class_of = {c: letters for letters in CLASSES for c in letters}
_given = {name: kind for kind, names in GIVEN.items() for name in names}
_pools = {kind: [n for n in (stem + ending for stem in STEMS[kind[1]] for ending in endings) if n not in _given] for kind, endings in ENDINGS.items()}
_starts = frozenset(_given) | frozenset(TITLES)

#: A capital letter of any script that has them, and the same for scripts without: two or three Han characters.
_UPPER = "A-ZÀ-ÖØ-Þ" + "".join(c for c in map(chr, range(0x100, 0x530)) if c.isupper())
_CAPITAL = rf"[{_UPPER}][^\W\d_]+(?:[-'’][{_UPPER}][^\W\d_]+)?"
_INITIAL = rf"(?:[{_UPPER}]\.[^\S\n]?){{1,3}}"
PATTERNS = re.compile(
    r"(?P<EMAIL>[^\W_][\w.+%-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)"
    r"|\b(?P<IBAN>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
    r"|(?:(?i:\b(?:api[_ -]?key|access[_ -]?key|auth|bearer|key|passw(?:or)?d|pwd|secret|token)\b)\s*[:=]\s*[\"'“]?)(?P<SECRET>[A-Za-z0-9+/_.-]{8,}=*)"
    r"|\b(?P<PREFIXED>(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}))(?![A-Za-z0-9])"
    r"|\b(?P<HEX>(?=[0-9]*[a-f])[0-9a-f]{32,}|(?=[0-9]*[A-F])[0-9A-F]{32,})\b"
    r"|(?<![\d.])(?P<IP>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\.?\d)"
    r"|(?<![\w.+-])(?P<CARD>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
    r"|(?<![\w-])(?P<SSN>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<PHONE>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
)
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NOT_TITLE = rf"(?!(?:{_TITLE})\b)"
_HAN_TITLES = "先生|女士|小姐|太太|教授|医生"
PERSON = re.compile(
    rf"\b(?P<title>{_TITLE})\b\.?[^\S\n](?P<titled>(?:{_INITIAL}[^\S\n]?)?{_NOT_TITLE}{_CAPITAL}(?:[^\S\n](?:{_INITIAL}[^\S\n]?)?{_NOT_TITLE}{_CAPITAL}){{0,2}})"
    rf"|\b(?P<first>{'|'.join(sorted(_given, key=len, reverse=True))})\b(?P<gap>[^\S\n](?:{_INITIAL}[^\S\n]?)?){_NOT_TITLE}(?P<last>{_CAPITAL})"
    rf"|(?P<han>[\u4e00-\u9fff]{{2,3}})(?={_HAN_TITLES})"
)
_PUNCTUATION = "\"'.,;:!?()[]{}<>«»„“”‘’*_-"


class Cycle:
    """One cycle through the numbers below `size`, keyed by `key`."""

    def __init__(self, key: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.key, self.mask = hashlib.blake2b(f"{key}/{size}".encode()).digest(), (1 << self.half) - 1

    def _round(self, k: int, value: int) -> int:
        out, need = b"", (self.half + 7) // 8
        while len(out) < need:
            out += hashlib.blake2b(bytes([k, len(out) // 64 % 256]) + value.to_bytes(need, "little"), key=self.key).digest()
        return int.from_bytes(out[:need], "little") & self.mask

    def _permuted(self, value: int, rounds: range) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            if rounds.step > 0:
                for k in rounds:
                    left, right = right, left ^ self._round(k, right)
            else:
                for k in rounds:
                    left, right = right ^ self._round(k, left), left
            value = left << self.half | right
            if value < self.size:
                return value

    def image(self, value: int) -> int:
        return self._permuted(value, range(8)) if self.size > 1 else value

    def after(self, value: int) -> int:
        if self.size < 2:
            return value
        return self._permuted((self._permuted(value, range(8)) + 1) % self.size, range(7, -1, -1))


def _spelled(key: str, value: str, classes: dict[str, str]) -> str:
    """The next string of the same format: characters without a class stay; long strings go in parts."""
    out = list(value)
    places = [k for k, c in enumerate(value) if c in classes]
    for part in range(0, len(places), 64):
        some = places[part : part + 64]
        number, size = 0, 1
        for k in some:
            letters = classes[value[k]]
            number, size = number * len(letters) + letters.index(value[k]), size * len(letters)
        shape = "".join(classes[value[k]][0] if value[k] in classes else value[k] for k in range(some[0], some[-1] + 1))
        number = Cycle(f"{key}/{part}/{len(value)}/{shape}", size).after(number)
        for k in reversed(some):
            letters = classes[value[k]]
            number, digit = divmod(number, len(letters))
            out[k] = letters[digit]
    return "".join(out)


def _check_digit(digits: str) -> int:
    """The digit that makes digits + it pass the Luhn test."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def _card(key: str, value: str) -> str:
    digits = re.sub(r"\D", "", value)
    body = _spelled(key + "CARD", digits[:-1], _class_of)
    new = iter(body + str((_check_digit(body) + int(digits[-1]) - _check_digit(digits[:-1])) % 10))
    return "".join(next(new) if c.isdigit() else c for c in value)


def _public(value: int) -> bool:
    a, b = value >> 24, value >> 16 & 255
    return not (a in (0, 10, 127) or a >= 224 or (a, b) == (192, 168) or (a, b) == (169, 254) or a == 172 and 16 <= b < 32)


def _address(key: str, value: str) -> str:
    number = int.from_bytes(map(int, value.split(".")), "big")
    cycle, space = Cycle(key + "IP", 1 << 32), _public(number)
    if not space:
        fixed = {10: 24, 127: 24, 0: 24, 172: 20, 192: 16, 169: 16}.get(number >> 24, 28)
        number = number >> fixed << fixed | Cycle(f"{key}IP{number >> fixed}", 1 << fixed).after(number & (1 << fixed) - 1)
    else:
        number = cycle.after(number)
        while not _public(number):
            number = cycle.after(number)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(key: str, value: str) -> str:
    plain = value.replace(" ", "")
    body = _spelled(key + "IBAN" + plain[:2], plain[4:], _class_of)
    new = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(new) for c in value)


def _email(key: str, value: str) -> str:
    local, _, host = value.rpartition("@")
    labels = host.split(".")
    fixed = 2 if re.fullmatch(r"(?i)example\.(?:com|net|org)", ".".join(labels[-2:])) else 1
    free = ".".join(labels[:-fixed])
    if not any(c in _class_of for c in local + free):
        return hashlib.blake2b((key + value).encode(), digest_size=6).hexdigest() + "@" + host
    # one cycle over local part and free labels together: equal hosts needn't stay equal, whole addresses stay distinct
    mapped = _spelled(key + "EMAIL" + ".".join(labels[-fixed:]), local + "@" + free, _class_of)
    return mapped + ("." if free else "") + ".".join(labels[-fixed:])


def _phone(key: str, value: str) -> str:
    head = re.match(r"\+\d{1,3}(?=[ .(-])|", value)[0]
    return head + _spelled(key + "PHONE" + head, value[len(head) :], _class_of)


def _secret(key: str, value: str) -> str:
    for letters in HEX:
        if len(value) >= 8 and all(c in letters for c in value):
            return _spelled(key + "HEX", value, dict.fromkeys(letters, letters))
    head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|", value)[0]
    if not any(c in _class_of for c in value[len(head) :]):
        head = ""
    return head + _spelled(key + "SECRET" + head, value[len(head) :], _class_of)


def _script(word: str) -> str:
    return "Cyrillic" if re.search("[\u0400-\u04ff]", word) else "Greek" if re.search("[\u0370-\u03ff]", word) else "Latin"


def pool(gender: str, script: str) -> list[str]:
    """The surrogate given names of a gender and script."""
    return _pools[gender, script]


def _name(key: str, value: str, gender: str = "") -> str:
    """A surrogate name for a listed given name; other names by letters, behind a surrogate name if the gender is known."""
    if value in _given:
        names = _pools[_given[value]]
        return names[Cycle(f"{key}NAME{_given[value]}", len(names)).image(GIVEN[_given[value]].index(value))]
    spelled = _spelled(key + "NAME", value, _class_of)
    if not gender or any(value.startswith(n) for n in _pools[gender, _script(value)]):
        return spelled
    names = _pools[gender, _script(value)]
    number = int.from_bytes(hashlib.blake2b(f"{key}NAME{gender}{value}".encode(), digest_size=8).digest(), "big")
    return f"{names[number % len(names)]}-{spelled}"


_MAKERS = {"EMAIL": _email, "IBAN": _iban, "SECRET": _secret, "PREFIXED": _secret, "HEX": _secret, "IP": _address, "CARD": _card, "SSN": lambda k, v: _spelled(k + "SSN", v, _class_of), "PHONE": _phone, "NAME": _name, "NAME_m": lambda k, v: _name(k, v, "m"), "NAME_f": lambda k, v: _name(k, v, "f")}
_TYPES = {"PREFIXED": "SECRET", "HEX": "SECRET", "NAME_m": "NAME", "NAME_f": "NAME"}
#: One of these stands, in lower case, in every text that `PATTERNS` finds something in; else a digit, an @ or a hex string.
_HINTS = ("key", "auth", "bearer", "passw", "pwd", "secret", "token", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "aiza")
_HEX_LETTERS = re.compile("[a-f]{32}|[A-F]{32}")
_PLAIN_WORDS = re.compile("[A-Z]?[a-z]+")


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each entity, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    lowered = text.lower()
    if any(c in text for c in "@0123456789") or any(h in lowered for h in _HINTS) or _HEX_LETTERS.search(text) or not text.isascii() and any(c.isdigit() for c in text):
        for m in PATTERNS.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            # a single plain word behind "key:" or "token:" is prose, behind "pwd:" or "=" it isn't
            if kind == "SECRET" and len(value) < 16 and _PLAIN_WORDS.fullmatch(value.rstrip(".")) and not re.match(r"(?i)passw|pwd|bearer|api|access", m[0].lstrip()) and "=" not in m[0][: m.start(kind) - m.start()]:
                continue
            end = m.end(kind) - (len(value) - len(value.rstrip(".")) if kind == "SECRET" else 0)
            found.append((m.start(kind), end, kind))
    if any(t in text for t in _HAN_TITLES.split("|")) or not _starts.isdisjoint(w.strip(_PUNCTUATION) for w in text.split()):
        names: dict[str, str] = {}
        persons: set[tuple[int, int]] = set()
        for m in PERSON.finditer(text):
            group = "titled" if m["titled"] else "han" if m["han"] else "last"
            spans = [(m.start(group) + p.start(), m.start(group) + p.end()) for p in re.finditer(r"[^\s.]+\.?", m[group])]
            if m["first"]:
                spans = [m.span("first"), *((m.start("gap") + p.start(), m.start("gap") + p.end()) for p in re.finditer(r"[^\s.]\.", m["gap"])), *spans]
            persons.update(spans)
            whole = [text[a:b] for a, b in spans if text[b - 1] != "."]
            for k, name in enumerate(whole):
                gender = TITLES.get(m["title"], "") if m["titled"] and not k and len(whole) > 1 else ""
                names[name] = names.get(name) or gender
        if names:
            again = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b")
            persons.update(m.span() for m in again.finditer(text))
            taken = found
            kinds = {"": "NAME", "m": "NAME_m", "f": "NAME_f"}
            found = sorted(taken + [(a, b, kinds[names.get(text[a:b], "")]) for a, b in persons if not any(a < y and x < b for x, y, _ in taken)])
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def surrogate(key: str, kind: str, value: str) -> str:
    """The next value of the same type and format on the keyed cycle."""
    return _MAKERS[kind](key, value)


def replaced(text: str, key: str) -> tuple[str, list[dict]]:
    """The text with surrogates, and what was found: type, begin, end (in the given text), surrogate."""
    found = find_entities(text)
    if not found:
        return text, []
    originals = {text[a:b] for a, b, _ in found}
    made: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    for a, b, kind in found:
        value = text[a:b]
        if (kind, value) in made:
            continue
        first = new = surrogate(key, kind, value)
        while new in used or new in originals and not (kind.startswith("NAME") and value in _given):
            new = surrogate(key, kind, new) if kind[:5] != "NAME_" and value not in _given else new + new[-1]
            if new == first:  # its cycle has no free value
                while new in used or new in originals:
                    new += new[-1]
        used.add(new)
        made[kind, value] = new
    out, at, listed = [], 0, []
    for a, b, kind in found:
        new = made[kind, text[a:b]]
        out += [text[at:a], new]
        at = b
        listed.append({"type": _TYPES.get(kind, kind), "begin": a, "end": b, "surrogate": new})
    return "".join(out) + text[at:], listed


ENTITIES = "array<struct<type:string,begin:int,end:int,surrogate:string>>"


def replace_private(df: DataFrame, key: str, text: str = "text", entities: str | None = "entities") -> DataFrame:
    """The rows with surrogates in `text`, and what was found as `entities` if that is named. Who has the key can undo it."""
    if entities:
        df = df.drop(entities)
    listed = pa.list_(pa.struct([("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    bounded_batches(df)
    schema = T.StructType([*df.schema.fields, *([T.StructField(entities, T._parse_datatype_string(ENTITIES), False)] if entities else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            done = [(None, []) if t is None else replaced(t, key) for t in part.column(text).to_pylist()]
            place = part.schema.get_field_index(text)
            columns = list(part.columns)
            columns[place] = pa.array([t for t, _ in done], part.schema.field(place).type)
            if entities:
                columns.append(pa.array([e for _, e in done], listed))
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *([entities] if entities else [])])

    return df.mapInArrow(run, schema)
