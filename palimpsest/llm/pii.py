"""PII surrogates: every detected entity gets a keyed replacement of its own type, script, gender and format.

What has a format (addresses, numbers, secrets) forms a number in a mixed radix: digits stay digits, letters
letters of their script, address bytes bytes. A keyed Feistel network permutes all numbers of that format, and
a shift inside it lets nothing map to itself; so different entities of a format differ afterwards. Spaces and
brackets are no part of a number, so one number gets one replacement in every way of writing it. Given names
move inside the list of their gender and script; other names are made of syllables of their script, with an
ending of their gender.

Collisions are checked over the whole corpus: the distinct entities of all texts are gathered in one table, and
an entity whose replacement is a real entity of its kind, or that of another one, tries again with the next
permutation or a longer name until none is left. Only entities that had to try again are told to the tasks: in
a broadcast up to ``BROADCAST_TRIES`` of them (each a hash and a number), above that joined to the texts they
stand in. A format of which more than a quarter of all values are real ones is left out of the check against
real ones: its replacements are distinct, but may be another's real value.

Person names are found after a title, or as a listed given name before a capitalised word; later mentions of
either part in the same text follow. Case is kept and plays no part in identity.

Defined results: a null text stays null with no entities, an empty one stays empty. All input columns stay as
they are but the text. Repeated rows get the same result. The key comes from ``spark.palimpsest.pii.key``;
where that is unset, each application draws one of its own, which nobody can know.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import slices
from palimpsest.session import cut, ship, spread, table

KEY_SETTING = "spark.palimpsest.pii.key"
ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "secret", "ssn", "iban", "person")
#: Entities with further tries that are broadcast; above, they are joined to their texts.
BROADCAST_TRIES = 200_000
#: Entities a task remembers, so that it hands on each once.
SEEN_ENTITIES = 100_000

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Barbara Carmen Charlotte Claudia Dorothy Elizabeth Emily Francesca Gabriela Heidi Isabella Jennifer Johanna Katharina Linda Margaret Michelle Patricia Rebecca Sophie Susan Ursula Victoria Abigail Amanda Amy Angela Anna Anne Annette Antonia Ashley Beatrice Beatriz Birgit Brenda Brigitte Camille Carla Carol Caroline Catherine Cecilia Céline Chantal Christina Christine Cristina Cynthia Deborah Denise Diana Diane Donna Elena Emma Eva Françoise Gisela Hannah Helen Helga Ingrid Isabel Isabelle Jacqueline Jane Janet Jessica Joanna Juana Judith Julia Julie Karen Karin Katherine Kathleen Kimberly Laura Lauren Lisa Louise Lucía Manuela María Maria Marie Martha Martina Mary Melissa Monica Monika Monique Nancy Natalie Nathalie Nicole Olivia Pamela Petra Pilar Rachel Renate Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Stephanie Susanne Sylvie Teresa Theresa Valérie Vanessa Véronique Virginia".split(),
    ("latin", "m"): "Alexander Andrew Benjamin Charles Christopher Daniel Edward Fernando Francisco George Guillermo Heinrich James Joseph Klaus Michael Nicholas Patrick Philippe Richard Robert Thomas William Wolfgang Adam Alain Albert Alberto Alejandro Alfred Álvaro Andreas Anthony Antoine Antonio Arthur Bernard Bernd Brandon Brian Bruno Carlos Christian David Dennis Diego Dieter Dirk Donald Douglas Dylan Enrique Eric Ernst Ethan Eugene Felix Florian François Frédéric Friedrich Gabriel Gary Gerhard Giovanni Gregory Guillaume Günter Hans Harald Harold Helmut Henri Henry Horst Hugo Ian Ignacio Jacques Jason Javier Jean Jeffrey Jerry Joachim Joe Johann John Jonas Jonathan Jorge José Joshua Juan Julien Jürgen Karl Kenneth Kevin Larry Laurent Lawrence Luis Lukas Manfred Manuel Marcel Marco Mario Markus Martin Matthew Matthias Mathieu Miguel Nathan Nicolas Olivier Oscar Otto Pablo Paul Pedro Peter Pierre Rafael Ralph Raymond Ronald Ryan Samuel Scott Sebastian Sergio Simon Stefan Stephen Steven Thierry Timothy Tyler Vincent Walter Werner Xavier".split(),
    ("cyrillic", "f"): "Анна Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
NAME_LISTS = {name.lower(): names for names in GIVEN.values() for name in names}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr MR HERR MONSIEUR SEÑOR".split(),
    "f": "Mrs Ms Miss Frau Madame Señora Sra Mme MRS MISS FRAU MADAME SEÑORA MME".split(),
    "x": "Dr Prof DR PROF".split(),
}
GENDER_OF = {t: g for g, titles in TITLES.items() for t in titles}
#: Words after which a given name before them is a place.
PLACES = frozenset("Airport Avenue Bridge Cathedral Church City College County Falls Hospital Hotel Island Lake Park River Road Square Station Street University".split())

# Syllables and endings of made names by script.
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v w br dr gr kr st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д з к л м н п р с т".split(), "а е и о у".split()),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split()),
}
ENDINGS = {
    ("surname", "latin", "x"): "man son berg ler ner ton ley ford well ard ing er".split(),
    ("surname", "cyrillic", "m"): "ов ев ин ский".split(),
    ("surname", "cyrillic", "f"): "ова ева ина ская".split(),
    ("surname", "greek", "m"): "ίδης άκης όπουλος".split(),
    ("surname", "greek", "f"): "ίδου άκη οπούλου".split(),
    ("given", "latin", "f"): "a ia ina ette elle isa".split(),
    ("given", "latin", "m"): "o us an en ert ik".split(),
    ("given", "latin", "x"): "i y is".split(),
    ("given", "cyrillic", "f"): "ина ана ия".split(),
    ("given", "cyrillic", "m"): "ан ей ир".split(),
    ("given", "greek", "f"): "ία ένη ώ".split(),
    ("given", "greek", "m"): "ος ης ας".split(),
}

#: Alphabets that letters stay in; anything else in an entity stays as it is.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëíîïñóôöùúûü", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
PLACE = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
HEX = "0123456789abcdef"

# What secrets begin with; FIND and MAY_HOLD both are made of these.
_AWS, _PREFIXED, _JWT = "(?:AKIA|ASIA)", "(?:gh[pousr]|github_pat|glpat|sk|pk|xox[abprs])[_-]", "eyJ"
FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w+%-][\w.+%-]*@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)(?![ .-]\d\d[ .-]\d\d(?!\d))|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8})\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![.]?\d)"
    r"|(?<![\w.+-])\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4}(?![\w-]|\.\d)|(?<![\w.+-])0\d(?P<pair>[ .-])\d\d(?:(?P=pair)\d\d){3}(?![\w-]|\.\d)"
    r"|(?<![\w.+-])0\d{2,4}[ /-]\d{3,4} ?\d{3,4}(?![\w-]|\.\d| \d{4}(?!\d)))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    rf"|(?P<secret>(?<!\w)(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?!\w)|(?<!\w){_AWS}[0-9A-Z]{{16}}(?!\w)|(?<!\w){_PREFIXED}[\w-]{{16,}}|(?<!\w){_JWT}[\w-]{{8,}}(?:\.[\w-]{{4,}}){{1,2}})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-]))"
)
#: Whatever FIND matches holds one of these: an at sign, a digit of any script, or what a secret without digits begins with.
MAY_HOLD = re.compile(rf"[@\d]|{_AWS}|{_PREFIXED}|{_JWT}|[a-f]{{32}}|[A-F]{{32}}")
#: What introduces a secret, and the values that count: quoted ones of any length, others of six characters, or four with a digit.
ASSIGNED = re.compile(
    r"(?i)(?<![a-z0-9])(?:(?:api|access|secret|private|auth|client|encryption)[_ -]?key|(?:\w{1,40}[_-])?(?:token|secret|password|passwd|passphrase|pwd))\b[\"']?\s*[:=]\s*"
    r"(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s\"']{6,}|(?=[^\s\"']*\d)[^\s\"']{4,5}(?![^\s])))"
)
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯΑ-Ω"
_TITLE = "|".join(GENDER_OF)
PERSON = re.compile(rf"\b(?:(?P<title>{_TITLE})\.?\s+)?(?P<first>[{_UPPER}]\w+)\s+(?P<last>[{_UPPER}][\w'-]+)|\b(?P<alone_title>{_TITLE})\.?\s+(?P<alone>[{_UPPER}][\w'-]+)")


def permute(symbols: list[int], bases: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation without fixed points of the mixed-radix numbers with these bases."""
    n, half = len(bases), len(bases) // 2
    sides = (range(half), range(half, n))

    def turn(x: list[int], r: int, sign: int) -> None:
        to, of = sides[r % 2], sides[1 - r % 2]
        seed = hmac.new(key, f"{tweak}|{bases}|{r}|{[x[i] for i in of]}".encode(), hashlib.sha512).digest()
        stream = hashlib.shake_256(seed).digest(8 * len(to))
        for k, i in enumerate(to):
            x[i] = (x[i] + sign * int.from_bytes(stream[8 * k : 8 * k + 8])) % bases[i]

    x = list(symbols)
    for r in range(ROUNDS):
        turn(x, r, 1)
    total = 1
    for b in bases:
        total *= b
    value = 0
    for s, b in zip(x, bases, strict=True):
        value = value * b + s
    shift = 1 + int.from_bytes(hmac.new(key, f"{tweak}|{bases}|shift".encode(), hashlib.sha256).digest()) % max(1, total - 1)
    value = (value + shift) % total
    for i in range(n - 1, -1, -1):
        value, x[i] = divmod(value, bases[i])
    for r in range(ROUNDS - 1, -1, -1):
        turn(x, r, -1)
    return x


def luhn(body: list[int]) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, d in enumerate(reversed(body)):
        total += d if i % 2 else 2 * d - 9 * (d > 4)
    return -total % 10


def script_of(name: str) -> str:
    low = name[:1].lower()
    return "cyrillic" if "\u0400" <= low <= "\u04ff" else "greek" if "\u0370" <= low <= "\u03ff" else "latin"


def entity_key(kind: str, identity: str) -> bytes:
    """A hash of fixed size that stands for an entity."""
    return hashlib.blake2b(f"{kind}\n{identity}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def cased(name: str, like: str) -> str:
    return name.upper() if like.isupper() and len(like) > 1 else name if like.islower() else name[:1].upper() + name[1:]


class Surrogates:
    """Replacements under one key. ``tries`` tells how often entities had to try again."""

    def __init__(self, key: bytes, tries: dict[bytes, int] | None = None):
        self.key, self.tries = key, tries or {}

    def numbered(self, symbols: str, keep: int, tweak: str, alphabet: str | None = None) -> tuple[list[int], list[str], str]:
        """Places that vary, their alphabets, and what tells the format."""
        at = [i for i, c in enumerate(symbols) if i >= keep and (c in alphabet if alphabet else c in PLACE)]
        held = set(at)
        return at, [alphabet or ALPHABETS[PLACE[symbols[i]][0]] for i in at], f"{tweak}|" + "".join("." if i in held else c for i, c in enumerate(symbols))

    def permuted(self, symbols: str, keep: int, tweak: str, attempt: int, alphabet: str | None = None) -> str:
        at, lists, layout = self.numbered(symbols, keep, tweak, alphabet)
        if not at:
            return symbols
        got = permute([a.index(symbols[i]) for i, a in zip(at, lists, strict=True)], [len(a) for a in lists], self.key, f"{layout}|{attempt}")
        out = list(symbols)
        for i, a, x in zip(at, lists, got, strict=True):
            out[i] = a[x]
        return "".join(out)

    # -- one entity ------------------------------------------------------------------------------

    def identity(self, kind: str, surface: str, gender: str = "x") -> str:
        """What all ways of writing an entity have in common."""
        if kind == "phone":
            country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", surface)
            n = country.end() if country else 0
            return surface[:n] + ":" + re.sub(r"\D", "", surface[n:])
        if kind in ("card", "ssn"):
            return re.sub(r"\D", "", surface)
        if kind == "iban":
            return surface.replace(" ", "").lower()
        if kind in ("email", "surname"):
            return "".join(c.lower() if len(c.lower()) == 1 else c for c in surface)
        if kind == "given":
            return surface.lower() if surface.lower() in NAME_LISTS else f"{gender}|{surface.lower()}"
        return surface

    def format_of(self, kind: str, identity: str) -> tuple[str, float]:
        """The format of an entity and the logarithm (base 2) of how many values it has; infinite for made names."""
        if kind == "ip":
            return "ip", 32.0
        if kind == "given" and "|" not in identity:
            names = NAME_LISTS[identity]
            return f"given {names[0]}", math.log2(len(names))
        if kind in ("given", "surname"):
            return kind, 1e9
        if kind == "card":
            return f"card {len(identity)}", (len(identity) - 1) * math.log2(10)
        if kind == "secret":
            low, alphabet = self.low(identity)
            _, lists, layout = self.numbered(low, 0, "secret", alphabet)
        elif kind == "email":
            _, lists, layout = self.numbered(identity, 0, "email")
        else:
            _, lists, layout = self.numbered(identity.rpartition(":")[2], 2 if kind == "iban" else 0, kind)
        return layout, sum(math.log2(len(a)) for a in lists)

    @staticmethod
    def low(secret: str) -> tuple[str, str | None]:
        whole = re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", secret)
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in secret), HEX if whole else None

    def surrogate(self, kind: str, identity: str, attempt: int = 0) -> str:
        """The identity that replaces one."""
        if kind == "phone":  # with or without its country a number stays the same
            country, _, digits = identity.partition(":")
            return f"{country}:{self.permuted(digits, 0, 'phone', attempt)}"
        if kind == "card":  # the last digit keeps its distance from the check digit: valid numbers stay valid
            digits = [int(c) for c in identity]
            body = permute(digits[:-1], [10] * (len(digits) - 1), self.key, f"card|{attempt}")
            return "".join(map(str, [*body, (luhn(body) + digits[-1] - luhn(digits[:-1])) % 10]))
        if kind == "ip":
            return ".".join(map(str, permute([int(x) for x in identity.split(".")], [256] * 4, self.key, f"ip|{attempt}")))
        if kind == "ssn":
            return self.permuted(identity, 0, "ssn", attempt)
        if kind == "iban":
            return self.permuted(identity, 2, "iban", attempt)
        if kind == "email":  # what follows the last dot stays
            n = identity.rindex(".")
            return self.permuted(identity[:n], 0, f"email{identity[n:]}", attempt) + identity[n:]
        if kind == "secret":
            low, alphabet = self.low(identity)
            n = len(re.match(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|pk-|xox[abprs]-|eyJ|", identity)[0])
            new = self.permuted(low, n, "secret", attempt, alphabet)
            return "".join(c.upper() if old != was else c for c, old, was in zip(new, identity, low, strict=True))
        if kind == "given" and "|" not in identity:
            names = NAME_LISTS[identity]
            low = [n.lower() for n in names]
            return low[permute([low.index(identity)], [len(names)], self.key, f"{names[0]}|{attempt}")[0]]
        gender, _, name = identity.rpartition("|")
        made = self.made(kind, name, gender or self.gender_of_surname(name), attempt)
        return f"{gender}|{made}" if gender else made

    @staticmethod
    def gender_of_surname(name: str) -> str:
        script = script_of(name)
        return "x" if script == "latin" else "f" if name.endswith(("а", "я", "ου", "η", "α")) else "m"

    def made(self, kind: str, name: str, gender: str, attempt: int) -> str:
        """A name of syllables; every second try adds one, so there is always a free name."""
        script = script_of(name)
        endings = ENDINGS.get((kind, script, gender)) or ENDINGS.get((kind, script, "m")) or ENDINGS[kind, script, "x"]
        heads, vowels = SYLLABLES[script]
        seed = hmac.new(self.key, f"{kind}|{gender}|{name}|{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha512).digest()
        n = 2 + attempt // 2
        draw = iter(hashlib.shake_256(seed).digest(4 * (2 * n + 2)))
        pick = lambda items: items[int.from_bytes(bytes(next(draw) for _ in range(4))) % len(items)]
        return "".join(pick(heads) + pick(vowels) for _ in range(n)) + pick(heads)[:1] + pick(endings)

    def written(self, kind: str, surface: str, new: str) -> str:
        """A replacement in the way its entity is written."""
        if kind == "phone":
            n = len(new.partition(":")[0])
            digits = iter(new.partition(":")[2])
            return surface[:n] + "".join(next(digits) if c.isdigit() else c for c in surface[n:])
        if kind in ("card", "ssn", "iban"):
            symbols = iter(new)
            return "".join((x.upper() if c.isupper() else x) if c.isalnum() and (x := next(symbols)) else c for c in surface)
        if kind == "email":
            return "".join(x.upper() if c != c.lower() else x for x, c in zip(new, surface, strict=True))
        if kind in ("given", "surname"):
            return cased(new.rpartition("|")[2], surface)
        return new

    def replacement(self, kind: str, surface: str, identity: str) -> str:
        tries = self.tries.get(entity_key(kind, identity), 0) if self.tries else 0
        return self.written(kind, surface, self.surrogate(kind, identity, tries))

    # -- texts -----------------------------------------------------------------------------------

    def people(self, text: str) -> dict[str, tuple[str, str]]:
        """The parts of names found in a text: kind and identity of each."""
        parts: dict[str, tuple[str, str]] = {}
        at = 0

        def put(part: str, kind: str, gender: str = "x") -> None:
            got = parts.setdefault(part, (kind, self.identity(kind, part, gender)))
            if len(part) > 3:  # the same name in capitals, or without
                parts.setdefault(part.upper(), got)
                parts.setdefault(part[:1] + part[1:].lower(), got)

        while m := PERSON.search(text, at):
            at = m.end()
            if m["alone"]:
                put(m["alone"], "surname")
            elif m["title"] or m["first"].lower() in NAME_LISTS and m["last"] not in PLACES:
                put(m["first"], "given", GENDER_OF.get(m["title"], "x"))
                put(m["last"], "surname")
            elif m["first"] in GENDER_OF:
                put(m["last"], "surname")
            else:
                at = m.start() + len(m["first"])
        return parts

    def entities(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """(start, stop, kind, identity) of every entity of a text in order; none overlap."""
        if not text:
            return []
        spans: list[tuple[int, int, str, str]] = []
        low = text.casefold()  # folds what the pattern's own case folding does
        # Assigned values come first, whatever they look like; what is found is blanked for what comes after.
        if ("=" in text or ":" in text) and any(w in low for w in ("token", "secret", "pass", "pwd", "key")):
            for m in ASSIGNED.finditer(text):
                value = m[m.lastgroup]
                if m.lastgroup == "bare":
                    value = value.rstrip(".,;!")
                start = m.start(m.lastgroup)
                spans.append((start, start + len(value), "secret", value))
            text = blanked(text, spans)
        if MAY_HOLD.search(text):
            found = [(m.start(), m.end(), m.lastgroup if m.lastgroup in KINDS else "phone", m[0]) for m in FIND.finditer(text)]
            spans += [(a, b, kind, self.identity(kind, surface)) for a, b, kind, surface in found]
            text = blanked(text, found)
        if parts := self.people(text):
            names = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + r")\b")
            spans += [(m.start(), m.end(), *parts[m[0]]) for m in names.finditer(text)]
        return sorted(spans)

    def apply(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with surrogates, and the entities of each kind."""
        found: dict[str, int] = {}
        spans = self.entities(text)
        if not spans:
            return text, found
        out, at = [], 0
        for start, stop, kind, identity in spans:
            name = "person" if kind in ("given", "surname") else kind
            found[name] = found.get(name, 0) + 1
            out += [text[at:start], self.replacement(kind, text[start:stop], identity)]
            at = stop
        return "".join([*out, text[at:]]), found


def blanked(text: str, spans: list[tuple]) -> str:
    """The text with spans made characters that are in no entity, so that places stay."""
    out, at = [], 0
    for start, stop, *_ in spans:
        out += [text[at:start], "\0" * (stop - start)]
        at = stop
    return "".join([*out, text[at:]])


# -- collision checks -------------------------------------------------------------------------------


def found_entities(docs: DataFrame) -> DataFrame:
    """(kind, identity, format, bits) of the distinct entities of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(b"")
        seen: set[bytes] = set()
        for part in slices(batches):
            rows = []
            for text in part["text"].to_pylist():
                for _, _, kind, identity in make.entities(text):
                    if (k := entity_key(kind, identity)) not in seen:
                        if len(seen) >= SEEN_ENTITIES:
                            seen.clear()
                        seen.add(k)
                        rows.append((kind, identity, *make.format_of(kind, identity)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["kind", "identity", "format", "bits"])

    return docs.select("text").mapInArrow(run, "kind string, identity string, format string, bits double").groupBy("kind", "identity").agg(F.first("format").alias("format"), F.first("bits").alias("bits"))


def with_surrogates(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for part in slices(batches):
            new = [make.surrogate(k, i, attempt) for k, i in zip(part["kind"].to_pylist(), part["identity"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["kind"], part["identity"], pa.array(new, pa.string())], names=["kind", "identity", "surrogate"])

    return entities.select("kind", "identity").mapInArrow(run, "kind string, identity string, surrogate string")


def further_tries(found: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, identity, tries) of the entities whose first replacement is a real entity or another's; None if there are none."""
    crowded = found.groupBy("kind", "format").agg(F.count("*").alias("n"), F.first("bits").alias("bits")).where(F.log2(F.col("n").cast("double")) + 2 > F.col("bits"))
    pending = found.join(crowded, ["kind", "format"], "left_anti").select("kind", "identity")
    real = found.select("kind", F.col("identity").alias("surrogate"))
    taken, again, attempt = None, None, 0
    while True:
        tried = cut(with_surrogates(pending, key, attempt))
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        won = cut(free.groupBy("kind", "surrogate").agg(F.min("identity").alias("identity")))
        if attempt:
            mine = won.select("kind", "identity", F.lit(attempt).alias("tries"))
            again = mine if again is None else again.unionByName(mine)
        taken = won.select("kind", "surrogate") if taken is None else taken.unionByName(won.select("kind", "surrogate"))
        pending = cut(tried.join(won, ["kind", "identity"], "left_anti").select("kind", "identity"))
        if pending.isEmpty():
            return again
        attempt += 1


def tries_by_text(docs: DataFrame, again: DataFrame, mark: str, tries: str) -> DataFrame:
    """(mark, tries): for each text with entities that tried again, their keys and tries. Texts go by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(b"")
        for part in slices(batches):
            rows = [(h, k) for h, t in zip(part["h"].to_pylist(), part["text"].to_pylist(), strict=True) for k in {entity_key(kind, i) for _, _, kind, i in make.entities(t)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.binary())], names=["h", "k"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys = [entity_key(k, i) for k, i in zip(part["kind"].to_pylist(), part["identity"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part["tries"].cast(pa.int32())], names=["k", "tries"])

    held = docs.where("text is not null").select(F.sha2("text", 256).alias("h"), "text").mapInArrow(run, "h string, k binary").distinct()
    told = held.join(again.mapInArrow(keyed, "k binary, tries int"), "k")
    return told.groupBy(F.col("h").alias(mark)).agg(F.collect_list(F.struct("k", "tries")).alias(tries))


def key_of(spark: SparkSession) -> bytes:
    """The configured key, or one that this application drew."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given.encode()
    sc = spark.sparkContext
    if not hasattr(sc, "_palimpsest_pii_key"):
        sc._palimpsest_pii_key = secrets.token_bytes(32)
    return sc._palimpsest_pii_key


def replace_pii(docs: DataFrame, key: bytes | None = None, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text; with ``counts`` also n_entities and the number of each kind.

    These counts take the place of columns so named.
    """
    spark = docs.sparkSession
    ship(spark)
    key = key or key_of(spark)
    extra = ["n_entities", *(f"n_{k}" for k in KINDS)] if counts else []
    docs = docs.drop(*extra)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in extra)])
    at, names = docs.columns.index("text"), [*docs.columns, *extra]
    again = further_tries(cut(found_entities(docs)), key)
    tries: dict[bytes, int] = {}
    own = None
    if again is not None:
        again = cut(again)
        if again.count() <= BROADCAST_TRIES:
            tries = {entity_key(r.kind, r.identity): r.tries for r in again.toLocalIterator()}
        else:
            mark, own = "_" * (1 + max(map(len, names))), "_" * (2 + max(map(len, names)))  # longer than any column's name
            docs = docs.withColumn(mark, F.sha2("text", 256)).join(tries_by_text(docs, again, mark, own), mark, "left").drop(mark)
            at = docs.columns.index("text")
    sent = spark.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key, sent.value)
        for part in slices(batches):
            if own is None:
                done = [make.apply(t) for t in part.column(at).to_pylist()]
            else:
                told = part[own].to_pylist()
                done = [Surrogates(key, {x["k"]: x["tries"] for x in o or ()}).apply(t) for t, o in zip(part.column(at).to_pylist(), told, strict=True)]
            columns = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != own]
            columns[at] = pa.array([t for t, _ in done], columns[at].type)
            if counts:
                columns.append(pa.array([sum(f.values()) for _, f in done], pa.int64()))
                columns += [pa.array([f.get(k, 0) for _, f in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, and how many entities of each kind it had, for every row of documents.

    Null ids and null texts pass through, empty texts stay empty, repeated rows come out alike; an empty table
    gives none. Other columns are not read.
    """
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id"), F.col("text"))
    return replace_pii(docs, counts=True)
