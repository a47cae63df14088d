"""Visually identical text with different characters: confusable skeletons.

A text's skeleton is what a reader sees of it: decompose, replace every character by
the prototype of its look, drop signs without ink, decompose again. Texts with equal
skeletons look the same.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn alike in common typefaces, and the Latin prototype of each, in the same order.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜҮӀаесоԁһіјрԛѕԝухүӏ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXGQWYIaecodhijpqswyxyl"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿνορϲϳ"
_GREEK_AS = "ABEZHIKMNOPTYXCJvopcj"
_ARMENIAN, _ARMENIAN_AS = "ՕՍՏօսոհցզ", "OUSounhgq"
_CHEROKEE, _CHEROKEE_AS = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"
_LISU, _LISU_AS = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"
_HYPHENS = "‐‑"
LOOKALIKES: dict[str, str] = dict(zip(_CYRILLIC + _GREEK + _ARMENIAN + _CHEROKEE + _LISU, _CYRILLIC_AS + _GREEK_AS + _ARMENIAN_AS + _CHEROKEE_AS + _LISU_AS)) | dict.fromkeys(_HYPHENS, "-")
# Signs that a reader may take for each other in some typefaces, though most show the difference.
_SMALL, _SMALL_AS = "ɑɡıɩɪʀᴀᴄᴅᴇᴊᴋᴍɴᴏᴘᴛᴜᴠᴡᴢ", "agiiiracdejkmnoptuvwz"
LOOSE: dict[str, str] = dict(zip(_SMALL, _SMALL_AS)) | {"I": "l", "1": "l", "|": "l", "0": "O", "m": "rn", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-"}

# Kinds of compatibility decomposition that change the look: raised, lowered, enclosed, stacked or turned.
_VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
# Without ink though not format characters: fillers, the grapheme joiner, variation selectors, carriage return.
_INKLESS = frozenset([0x0D, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])


def _prototype(code: int, alike: dict[str, str], depth: int = 0) -> str:
    c = chr(code)
    kind = unicodedata.category(c)
    if kind == "Cf" or code in _INKLESS:
        return ""
    if kind == "Zs" or c == "\t":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    if c in alike:
        return alike[c]
    how = unicodedata.decomposition(c)
    if not how and not 0xAC00 <= code <= 0xD7A3 or how.startswith(_VISIBLE) or depth > 8:
        return c
    parts = unicodedata.normalize("NFD", c) if not how.startswith("<") else "".join(chr(int(x, 16)) for x in how.split()[1:])
    return c if parts == c else "".join(_prototype(ord(x), alike, depth + 1) for x in parts)


class _Prototypes(dict):
    """Prototype of each character, worked out when first met."""

    def __init__(self, alike: dict[str, str]):
        super().__init__()
        self.alike = alike

    def __missing__(self, code: int) -> str:
        self[code] = p = _prototype(code, self.alike)
        return p


_TABLE, _LOOSE_TABLE = _Prototypes(LOOKALIKES), _Prototypes(LOOKALIKES | LOOSE)


def skeleton(text: str, loose: bool = False) -> str:
    """The form all texts with the same look share. Case, accents, raised digits, punctuation and blanks stay.

    ``loose`` takes signs as equal, too, that are alike in some typefaces only (``LOOSE``).
    """
    if loose:
        text = unicodedata.normalize("NFD", text).translate(_LOOSE_TABLE).translate(_LOOSE_TABLE)  # the prototype of a look-alike may have one, too
        return unicodedata.normalize("NFD", text)
    if text.isascii() and "\t" not in text and "\r" not in text and text.isprintable():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def consistent_form(text: str) -> str:
    """The skeleton with its accents composed: the one spelling kept for all texts that look like it."""
    return unicodedata.normalize("NFC", skeleton(text))


def forms(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(doc_id, form, changed)``: the consistent form of each text; a null text has a null form. Repeated rows stay repeated."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("text").to_pylist()
            f = [None if x is None else consistent_form(x) for x in t]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.string()), pa.array([a != x for a, x in zip(f, t)])], ["doc_id", "form", "changed"])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(read, "doc_id bigint, form string, changed boolean")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def looks(docs: DataFrame, id: str, text: str, loose: bool = False) -> DataFrame:
    """``(doc_id, look, spelling)``: 128-bit digests of each text's skeleton and of the text itself; null ids and texts are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_digest(skeleton(x, loose)) for x in t], pa.binary()), pa.array([_digest(x) for x in t], pa.binary())], ["doc_id", "look", "spelling"])

    rows = docs.filter(F.col(id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(read, "doc_id bigint, look binary, spelling binary")


def _several(at: DataFrame) -> DataFrame:
    """Looks with several spellings: ``(look, n_spellings, n_docs, class_id)``, counted before the shuffle."""
    spellings = at.groupBy("look", "spelling").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return spellings.groupBy("look").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_docs"), F.min("first").alias("class_id")).filter("n_spellings > 1")


SQUARE = 1_000


def equal_looks(docs: DataFrame, id: str, text: str, loose: bool = False, square: int = SQUARE) -> DataFrame:
    """Pairs ``(doc_id_a, doc_id_b)``, doc_id_a < doc_id_b, of different strings with the same look.

    Only looks with several spellings are joined, so that exact copies, however
    many, cost one row a task. The pairs of a look of many documents are found in squares of
    about ``square`` x ``square`` rows, each a key of its own. Pairs of exact copies are no pairs here. Repeated rows
    count once. An empty text equals texts without any ink. An empty table gives no pairs.
    """
    at = looks(docs, id, text, loose)
    several = _several(at).select("look", F.ceil(F.col("n_docs") / square).cast("int").alias("k"))
    kept = at.join(several, "look").dropDuplicates(["doc_id", "look", "spelling"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    all_k = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    a = kept.select("look", F.col("own").alias("i"), all_k.alias("j"), F.col("doc_id").alias("doc_id_a"), F.col("spelling").alias("spelling_a"))
    b = kept.select("look", all_k.alias("i"), F.col("own").alias("j"), F.col("doc_id").alias("doc_id_b"), F.col("spelling").alias("spelling_b"))
    return a.join(b, ["look", "i", "j"]).filter("doc_id_a < doc_id_b AND spelling_a <> spelling_b").select("doc_id_a", "doc_id_b")


def groups(docs: DataFrame, id: str, text: str, loose: bool = False) -> DataFrame:
    """``(doc_id, class_id, n_docs, n_spellings)`` of every document whose look has several spellings: one row each, not pairs.

    ``class_id`` is the smallest id among the documents of the look, ``n_docs`` the rows with that look.
    """
    at = looks(docs, id, text, loose)
    return at.join(_several(at), "look").select("doc_id", "class_id", "n_docs", "n_spellings").distinct()
