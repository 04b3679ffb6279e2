"""Quality rules, line first.

Every line is judged by itself: lines of marks, lines of navigation, lines of boilerplate (notices of rights and licences by
their shape, phrases of sites in several languages), lines of links and lines that repeat one word are removed, and long lines that do not end like a
sentence; then a document that lost too much of its text is rejected. A line counts for the first rule that it breaks. Base statistics are counted on the whole text beside it.

A line rule never looks at other lines, so a document is one row from scan to result, without shuffle.
Null text counts as the empty text; a text without words fails the base rules. Repeated rows are judged alike. Columns of
the input other than the id and the text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, mix

_SPACES = " \t\n\v\f\r"
_WORDS = re.compile(rf"[^{_SPACES}]+")
_SYMBOLS = b"#*$%&|<>"
LINKS = ("http://", "https://", "www.")
END = (".", "!", "?", '"', "'", "”", "’", "»", "…", ":", ";", ")", "。", "！", "？", "」", "』", "）", "।", "॥", "؟", "۔", "።")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document rule."""

    #: A line of at least this many words must end like a sentence; list entries and headings are shorter.
    sentence_words: int = 30
    #: Share of a line's characters that may be symbols of ``#*$%&|<>``.
    symbol_share: float = 0.2
    #: Separators between short entries that make a navigation line.
    navigation: str = r"(?:[\x20\x09-\x0D][|»›>·•/][\x20\x09-\x0D][^|»›>·•/]{0,30}){3,}"
    #: Phrases of sites, in lower case and by language; a line of at most ``boilerplate_words`` words with one goes, in whatever language it is.
    phrases: tuple[str, ...] = (
        # English
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
        "click here", "sign up for", "subscribe to our", "read more", "share this", "follow us on", "powered by", "lorem ipsum", "skip to content",
        # German
        "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "javascript aktivieren", "hier klicken", "klicken sie hier",
        "newsletter abonnieren", "jetzt weiterlesen", "folgen sie uns", "zum inhalt springen",
        # French
        "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "utilise des cookies", "activer javascript", "cliquez ici",
        "abonnez-vous", "lire la suite", "suivez-nous", "aller au contenu",
        # Spanish
        "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "utiliza cookies", "activar javascript", "haga clic aquí", "haz clic aquí",
        "suscríbete a", "leer más", "síguenos en", "saltar al contenido",
    )
    #: Shapes of notices of rights and licences, matched in the lower-cased line; each holds one of ``hints``.
    notices: tuple[str, ...] = (
        r"(?:©|\(c\)|copyright)[\x20\x09-\x0D]*(?:©|\(c\))?[\x20\x09-\x0D]*[0-9]{4}", r"(?:licen[cs]ed|released|distributed|published|available|provided) under [^.]{0,80}licen[cs]e",
        r"spdx-license-identifier:", r"(?:lizenziert|veröffentlicht|freigegeben|steht|stehen) unter [^.]{0,80}lizenz",
        r"(?:distribué|publié|diffusé|disponible)e?s? sous (?:la )?licence ", r"(?:distribuid|publicad|licenciad|disponible)[a-z]{0,2} bajo (?:la |una )?licencia ",
    )
    hints: tuple[str, ...] = ("©", "(c)", "copyright", "licen", "lizenz")
    boilerplate_words: int = 25
    #: A line with more than this share of its words being links goes.
    link_share: float = 0.5
    #: A line of at least ``run_words`` words in which one word makes up more than this share goes.
    run_words: int = 20
    run_share: float = 0.3
    #: A document that lost more than this share of its word characters is rejected.
    lost_share: float = 0.5


#: The line rules in the order in which they are tried.
LINE_RULES = ("symbols", "navigation", "boilerplate", "links", "repetition", "unended")


def broken_rule(line: str, words: list[str], rules: Rules, navigation: re.Pattern, notices: re.Pattern) -> int:
    """The place in ``LINE_RULES`` of the first rule that a line, given with its words, breaks; -1 if none."""
    n = len(words)
    if sum(map(line.count, "#*$%&|<>")) > rules.symbol_share * sum(map(len, words)):
        return 0
    if navigation.search(line):
        return 1
    low = line.lower()
    if n <= rules.boilerplate_words and (any(p in low for p in rules.phrases) or any(h in low for h in rules.hints) and notices.search(low)):
        return 2
    if ("://" in low or "www." in low) and sum(w.startswith(LINKS) for w in _WORDS.findall(low)) > rules.link_share * n:
        return 3
    if n >= rules.run_words and Counter(words).most_common(1)[0][1] > rules.run_share * n:
        return 4
    return 5 if n >= rules.sentence_words and not line.rstrip(_SPACES).endswith(END) else -1


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words covered by windows of ``size`` words that the text holds twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc += h[k : k + n] * PLACE[k]
    mix(acc)
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(acc, twice)).tolist()
    # equal hashes are only candidates: count the words themselves
    times = Counter(tuple(words[i : i + size]) for i in at)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if times[tuple(words[i : i + size])] > 1:
            cover[i] += 1
            cover[i + size] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _judge(rules: Rules, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        navigation = re.compile(rules.navigation)
        notices = re.compile("|".join(rules.notices))
        for batch in batches:
            out = []
            for item in batch.column(1):
                text = item.as_py() or ""
                raw = text.encode()
                words = raw.split()
                chars = sum(map(len, words)) - (len(raw) - len(text))
                lines, seen, repeats, lost, kept, hits = text.split("\n"), set(), 0, 0, [], [0] * len(LINE_RULES)
                for line in lines:
                    own = _WORDS.findall(line)
                    if not own:
                        continue
                    if line in seen:
                        repeats += 1
                    seen.add(line)
                    rule = broken_rule(line, own, rules, navigation, notices)
                    if rule < 0:
                        kept.append(line)
                    else:
                        lost += sum(map(len, own))
                        hits[rule] += 1
                n, again = len(words), repeated_words(words)
                failed = n < 20 or 100 * again > 30 * n
                out.append((n, chars, sum(map(raw.count, (bytes([b]) for b in _SYMBOLS))), repeats, again, failed, not failed and lost <= rules.lost_share * chars, lost, *hits, "\n".join(kept)))
            if out:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * (1 + len(LINE_RULES)) + [pa.string()] * texts
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=_NAMES[: len(kinds) + 1])

    return run


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", *(f"lines_{r}" for r in LINE_RULES), "cleaned"]


def clean(docs: DataFrame, rules: Rules = Rules(), texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Statistics, verdict, lines lost by each rule and, with ``texts``, the text without its failed lines (``cleaned``), a row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _judge(rules, texts),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, lost_chars long" + "".join(f", lines_{r} long" for r in LINE_RULES) + ", cleaned string" * texts,
    )


def report(cleaned: DataFrame) -> DataFrame:
    """rule, lines and documents: how many lines went by each line rule, and of how many documents; a row per rule."""
    counts = cleaned.agg(*(f(F.col(f"lines_{r}")).alias(f"{k}_{r}") for r in LINE_RULES for k, f in (("lines", lambda c: F.coalesce(F.sum(c), F.lit(0))), ("docs", lambda c: F.count_if(c > 0)))))
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"lines_{r}").alias("lines"), F.col(f"docs_{r}").alias("documents")) for r in LINE_RULES))
    return counts.select(F.explode(rows).alias("x")).select("x.*")
