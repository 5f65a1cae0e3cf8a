"""Line-first cleaning: rules per line, then a verdict per document.

Every line is judged by itself. A line fails

- *punctuation*: it has under ``min_line_words`` words and no closing mark, or more than
  ``max_symbol_share`` of its word characters are symbols;
- *navigation*: at least three of its words, and a fifth of them, are menu separators;
- *boilerplate*: it has at most ``max_notice_words`` words and a phrase of site furniture.

Failed lines are removed. A document is rejected when the base rules fail (under ten words, or over 20 %
of its words in repeated five-word windows) or when removal took more than ``max_loss`` of its word
characters. One pass over whole texts, no exchange.

Defined cases: a null text has no words and fails the base rules; white-space-only lines are neither
judged nor counted; repeated rows get equal results; other columns are ignored; an empty table gives
no rows; texts of any length are handled line by line and window counts use memory in proportion to
one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Marks that close a sentence or a quotation.
CLOSING = tuple(x.encode() for x in (".", "!", "?", "…", '"', "'", "”", "’", "»", ")", ":", ";", "。", "！", "？"))
#: Separators of menus and breadcrumbs.
SEPARATORS = frozenset(x.encode() for x in ("|", "||", "»", "«", "›", "‹", "·", "•", "/", ">", "<", "→", "::", "~"))
#: Phrases of site furniture, lower case: English, German, French, Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "by using this site", "click here", "cookie policy", "cookies to improve",
    "copyright ©", "enable javascript", "follow us on", "forgot your password", "javascript is disabled", "leave a comment", "log in to",
    "lorem ipsum", "page not found", "powered by wordpress", "privacy policy", "read more", "share this", "sign up for", "skip to content",
    "subscribe to our", "terms of service", "terms of use", "use cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-richtlinie", "datenschutzerklärung", "folgen sie uns", "javascript aktivieren", "kommentar hinterlassen",
    "nach oben", "newsletter abonnieren", "nutzungsbedingungen", "passwort vergessen", "seite nicht gefunden", "verwendet cookies", "weiterlesen", "zum inhalt springen",
    "abonnez-vous à", "accepter les cookies", "aller au contenu", "conditions d'utilisation", "haut de page", "laisser un commentaire", "lire la suite", "mentions légales",
    "mot de passe oublié", "page introuvable", "politique de confidentialité", "suivez-nous sur", "tous droits réservés", "utilise des cookies",
    "aceptar cookies", "aviso legal", "condiciones de uso", "dejar un comentario", "habilite javascript", "leer más", "olvidó su contraseña", "política de privacidad",
    "página no encontrada", "saltar al contenido", "suscríbase a", "síguenos en", "todos los derechos reservados", "términos de uso", "utiliza cookies", "volver arriba",
)
_NOTICE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


@dataclass(frozen=True)
class LineRules:
    min_line_words: int = 6
    max_symbol_share: float = 0.08
    max_notice_words: int = 25
    max_loss: float = 0.5


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """Name of the first rule that a line with words fails."""
    if len(words) < rules.min_line_words and not words[-1].endswith(CLOSING):
        return "punctuation"
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 3 and 5 * separators >= len(words):
        return "navigation"
    symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    if symbols > 3 and symbols > rules.max_symbol_share * sum(map(len, words)):
        return "punctuation"
    if len(words) <= rules.max_notice_words and _NOTICE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(codes) == len(words):
        return 0
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    windows, kinds = ids[:n], len(codes)
    for i in range(1, width):  # exact: renumber before the product could overflow
        if kinds * len(codes) >= 1 << 62:
            distinct, windows = np.unique(windows, return_inverse=True)
            kinds = len(distinct)
        windows = windows * len(codes) + ids[i : i + n]
        kinds *= len(codes)
    _, number, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[number] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, np.int32)
    cover[starts] += 1
    cover[starts + width] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: bytes, rules: LineRules) -> tuple[tuple, bytes]:
    """Counts, verdicts and the cleaned text of one document."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    letters = int(counts[~_CONTINUATION].sum() - counts[_SPACE].sum())
    repeat = repeated_words(words)
    base_failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    seen, duplicates, failed, lost, kept = set(), 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0, []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        rule = line_fails(line, own, rules)
        if rule:
            failed[rule] += 1
            lost += sum(map(len, own))
        else:
            kept.append(line)
    total = sum(map(len, words))
    keep = not base_failed and lost <= rules.max_loss * total
    return (len(words), letters, int(counts[_SYMBOL].sum()), duplicates, repeat, base_failed, keep, *failed.values(), lost / total if total else 0.0), b"\n".join(kept)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, with_text: bool = False) -> DataFrame:
    """Per row: id, counts, ``base_failed``, ``kept``, failed lines by rule, ``loss`` and, if asked for, ``clean_text``."""
    rules = rules or LineRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_punctuation", "lines_navigation", "lines_boilerplate", "loss"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        results = [judge(t.as_py(), rules) for t in batch.column(1)]
        cols = list(zip(*(r for r, _ in results), strict=True)) if results else [[]] * len(names)
        texts = [t for _, t in results] if with_text else [None] * len(results)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], pa.array(texts, pa.binary())], ["id", *names, "clean"])

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_punctuation long, lines_navigation long, lines_boilerplate long, loss double, clean binary"
    out = common.arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), common.text_bytes(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)
    return out.withColumn("clean_text", F.col("clean").cast("string")).drop("clean") if with_text else out.drop("clean")
