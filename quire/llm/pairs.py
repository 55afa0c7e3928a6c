"""Broken prompt and response pairs: defects of renderings (problem 2).

Responses are sorted by text over the whole table and every one is compared with its neighbours in that
order. One whose text goes on in a neighbour may be a shortened version, which its length has to
confirm. One that begins as another does, over more words than their sources share, follows a
template instead of its source: if it explains little of the source as well, it declines. Mostly a
neighbour is the other one; where none is and the verdict hangs on it, all responses that begin with the
same words, one excepted, are searched. Lengths at
which far more responses end than at the lengths around, most of them without a full stop, are limits
that cut them. These marks, and what each response explains of its source by the word table of sentence
alignment, go into the rules for copies, refusals, other languages and early ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.align import Block, Table, align_block, match, train, with_table
from quire.llm.sentences import sentences
from quire.session import latest, lookup_join, stored

#: Reasons that are no defect of the rendering. Fixed values.
EXEMPT_REASONS = ("kept_original", "page_shared_scale")
#: Words a source must have at least.
LEAST_WORDS = 4
#: Share of the source's words that a copy gives back in order, and of its end that an early end leaves out.
COPY, LEFT_OUT = 0.74, 0.25
#: As much is asked of a response that visibly breaks off, where what it lacks is only estimated.
BREAKS_OFF = 0.17
#: Share of a response's words that come from the source in a rendering.
RENDERS = 0.3
#: Different neighbours a response is compared with on either side before any other (``begins_alike`` searches the
#: rest), words by which it must be more like one than their sources are, and words of the response that a word and a
#: function word of both sources stand for.
NEAR, TEMPLATE, STANDS_FOR = 6, 3, (2, 1)
#: Words by which the search among all responses joins at most, one excepted.
DEEPEST = 6
#: A length is a limit if its responses exceed those around by so many standard deviations (and a few rows), this share without an end.
SPIKE_SIGMA, SPIKE_TIMES, SPIKE_OPEN = 6.0, 4.0, 0.8

#: Units that stay as they are. Fixed values.
UNITS = frozenset("mm cm m km kg g mg t v kv w kw mw a ma bar pa kpa mpa rpm l ml litre litres hz khz mhz ghz s ms min h c f k b kb mb gb db x".split())
#: Frequent words that show the language of a text. Fixed values.
LANGUAGE_WORDS = {
    "en": "the and of to in is was with that for on at it as by from this are not which have has i you your please",
    "de": "der die das und den dem des ein eine einen einem ist war mit von zu im am auf für nicht nach bei aus über unter vor wurde hat sich",
    "fr": "le la les l un une et des du de dans est était avec pour sur au aux par qui que a ont selon sous pas d en",
    "es": "el la los las un una y de del en es era con por para al que según sobre bajo se no lo fue su",
    "it": "il lo la gli le un una e di del della dei nel nella è era con per sul che non sotto dopo si alla al",
    "pt": "o a os as um uma e de do da dos das no na em é era com por para que não ao sob se",
    "nl": "de het een en van in is was met op voor niet naar bij uit over onder dat door aan",
    "pl": "i w na z do jest był się nie że po od pod przez dla oraz",
    "tr": "ve ile bir bu da de için gibi ama göre sonra önce kadar daha çok hem ki ne en altında üstünde içinde arasında yanında değil olarak",
}
#: Stems of apologies and of what a language model calls itself. Fixed values.
APOLOGY = re.compile(
    r"sorry|apolog|unfortunately|language model|özür|üzgün|maalesef|ne yazık|kusura bak|dil modeli|çevirem|leider|entschuldig|tut mir leid|sprachmodell"
    r"|désolé|malheureusement|modèle de langage|lo siento|lamentablemente|lamento|modelo de lenguaje|purtroppo|spiacente|infelizmente|helaas|niestety",
    re.IGNORECASE,
)
#: Closing dots and blanks, which don't count where responses are sorted and compared.
TAIL = " .…\n\r\t\u00a0"
_words = re.compile(r"[^\W_]+(?:[.,]\d+)*")
_close = re.compile(r"[\s\"'”’»)\]*_`]+\Z")
_cut_off = re.compile(r"(?:…|\.\.\.)[\s\"'”’»)\]*_`]*\Z")
_languages = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}
_foreign_letters = frozenset("äßéèêëàùñáíóúìòãõœæåøąęłńśźżčřšžěů")
_turkish_letters, _plain_letters = frozenset("ğış"), frozenset("abcdefghijklmnopqrstuvwxyzçğıöşü")
_quoted = re.compile("[“„«\"][^”“»\"]*[”“»\"]")
#: Endings of a finite Turkish verb, which closes a complete sentence. Fixed values.
_verb = re.compile(r"(?:[dt][ıiuü](?:m|n|k|lar|ler)?|[ıiuüae]r(?:lar|ler)?|yor|m[ıiuü]ş|[ae]ca[kğ]|ece[kğ]|mal[ıi]|meli|[dt][ıiuü]r)\Z")
#: Turkish characters for one of the English source.
RATIO = 0.87
_small = {w: 1 << k for k, w in enumerate(sorted(_languages["en"]))}
_foreign = frozenset().union(*(v for k, v in _languages.items() if k != "tr")) - _languages["tr"]


def fold(text: str | None) -> list[str]:
    """The words of a text in lower case, without marks."""
    return _words.findall((text or "").replace("İ", "i").lower())


def is_empty(text: str | None) -> bool:
    """Null, or without any letter or digit."""
    return text is None or not any(c.isalnum() for c in text)


def stays(source: str, table: Table) -> bool:
    """Whether the source has too few words, or only names, numbers, units and codes."""
    found = _words.findall(source)
    if len(source.split()) < LEAST_WORDS or len([w for w in found if not w[0].isdigit()]) < 1:
        return True
    for w in found:
        low = w.lower()
        if any(c.isdigit() for c in w) or low in UNITS:
            continue
        if w[0].islower() or low in table.plain:
            return False
    return True


def in_order(source: list[str], target: list[str]) -> float:
    """Share of the source's words that the target gives back in order (longest common subsequence)."""
    if not source or not target:
        return 0.0
    own = set(target)
    if sum(w in own for w in source) < COPY * len(source) or sum((Counter(source) & Counter(target)).values()) < COPY * len(source):
        return 0.0
    # Bit-parallel longest common subsequence.
    at: dict[str, int] = {}
    for i, w in enumerate(source):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(source)) - 1
    row = full
    for w in target:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return (len(source) - row.bit_count()) / len(source)


def _speaks(word: str, known: Table) -> int:
    """1 for a word of another language than Turkish, -1 for a Turkish one, 0 for one that doesn't tell."""
    if word in _foreign or not _foreign_letters.isdisjoint(word) or _plain_letters.isdisjoint(word):
        return 1
    return -(word in _languages["tr"] or not _turkish_letters.isdisjoint(word) or word.replace("ı", "i") in known.entries)


def other_language(words: list[str], source: set[str], known: Table, seen: dict[str, int]) -> bool:
    """Whether the words speak for another language than Turkish; those quoted from the source don't count.

    ``seen`` keeps what each word says.
    """
    foreign = turkish = 0
    for w in words:
        if w[0].isdigit() or w in source:
            continue
        if (says := seen.get(w)) is None:
            says = seen[w] = _speaks(w, known)
        if says > 0:
            foreign += 1
        elif says:
            turkish += 1
    return foreign > 0 and foreign >= turkish


def _ended(text: str) -> bool:
    """Whether a text closes with a sentence mark."""
    bare = _close.sub("", text)
    return bool(bare) and bare[-1] in ".!?…:;。"


def left_out(source: list[str], target: list[str], pairs: list[tuple[int, int]], explained: dict[int, float]) -> tuple[float, bool]:
    """Share of the source's characters that the target leaves out at the end, and whether it breaks off.

    ``pairs``: which sentences render each other. ``explained``: of each source sentence the share of
    its words that the target explains. Sentences after the last one rendered are left out. Of that
    one, if it breaks off there, the part that isn't explained.
    """
    sizes = [len(s.strip()) for s in source]
    total = sum(sizes)
    done = max((i for i, _ in pairs), default=-1)
    if not total or not target or done < 0:
        return 0.0, False
    last = target[-1].strip()
    bare = fold(last)
    if _cut_off.search(last):
        broken = not _cut_off.search(source[-1].rstrip())
    elif _ended(last):
        broken = False
    else:
        # Without a sentence mark: cut, unless the source has none either and a verb closes the target.
        broken = _ended(source[-1]) or not (bare and _verb.search(bare[-1])) and explained.get(done, 1.0) < 0.8
    if not broken:
        # A closing sentence that isn't recognised renders the one that comes next.
        seen = {j for _, j in pairs}
        unknown = next((k for k in range(len(target)) if len(target) - 1 - k in seen), 0)
        return sum(sizes[done + 1 + unknown :]) / total, False
    by_size = len(last) / max(1.0, RATIO * sizes[done])
    got = (min(1.0, by_size) + min(1.0, explained.get(done, 1.0))) / 2 if any(j == len(target) - 1 for _, j in pairs) else 1.0
    return (sum(sizes[done + 1 :]) + sizes[done] * (1 - got)) / total, True


def judge(rows: pd.DataFrame, table: Table) -> list[str | None]:
    """The defect of each row of (source_text, translated_text, shortened, at_limit, template), or None."""
    return judged(rows, table)[0]


def judged(rows: pd.DataFrame, table: Table) -> tuple[list[str | None], list[bool]]:
    """``judge``, and for each row whether it would be a refusal if it followed a template, but isn't one so."""
    out: list[str | None] = [None] * len(rows)
    hangs = [False] * len(rows)
    sources, targets = rows["source_text"].tolist(), rows["translated_text"].tolist()
    shortened, at_limit = rows["shortened"].tolist(), rows["at_limit"].tolist()
    template = rows["template"].tolist() if "template" in rows else [False] * len(rows)
    open_rows, said = [], {}
    seen: dict[str, int] = {}
    for k, (s, t) in enumerate(zip(sources, targets)):
        if s is None or stays(s, table):
            continue
        if is_empty(t):
            out[k] = "empty"
            continue
        said[k] = fold(s), fold(t)
        if in_order(*said[k]) >= COPY and _copies(s, t):
            out[k] = "copy"
        else:
            open_rows.append(k)
    s_split = [sentences(sources[k]) for k in open_rows]
    t_split = [sentences(targets[k]) for k in open_rows]
    if not open_rows:
        return out, hangs
    block = match(s_split, t_split, table)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for g, i, j in align_block(block):
        pairs.setdefault(g, []).append((i, j))
    shares, covered = _explained(block, len(open_rows))
    for g, k in enumerate(open_rows):
        own, words = said[k]
        renders = covered[g]
        # Where most of the response renders the source, nothing declines and no other language speaks.
        declines = renders < RENDERS and (template[k] or bool(APOLOGY.search(targets[k])) and not (renders >= RENDERS / 2 and APOLOGY.search(sources[k])))
        foreign = renders < 0.5 and other_language(words, set(own), table, seen)
        # Shorter than what a rendering without the last quarter would be.
        short = len(targets[k].strip()) < (1 - LEFT_OUT) * RATIO * len(sources[k].strip())
        candidate = shortened[k] or (at_limit[k] and not _ended(targets[k]))
        if declines:
            out[k] = "refusal"
        elif foreign:
            english = sum(w in _languages["en"] for w in words)
            rest = max(sum(w in v for w in words) for lang, v in _languages.items() if lang not in ("en", "tr"))
            # English that isn't the source's own words doesn't render anything.
            out[k] = "refusal" if english > rest and not _same_names(own, words) else "wrong_language"
        elif pairs.get(g):
            lost, broken = left_out(s_split[g], t_split[g], pairs.get(g, []), shares[g])
            # A closed sentence that is paired may be short for other reasons than an early end.
            if lost >= (BREAKS_OFF if broken or candidate else LEFT_OUT) or candidate and short and not _ended(targets[k]):
                out[k] = "truncated"
        elif candidate or not _ended(targets[k]) or _cut_off.search(targets[k]):
            # Too little of it to tell what it renders: an end after a word or two.
            if short:
                out[k] = "truncated"
        hangs[k] = renders < RENDERS and out[k] != "refusal"
    return out, hangs


def _copies(source: str, target: str) -> bool:
    """Whether the target adds no more than a lead-in to the source it gives back."""
    return len(target.strip()) <= 1.5 * len(source.strip()) + 60


def _same_names(source: list[str], target: list[str]) -> bool:
    """Whether numbers of the source come back."""
    return not {w for w in source if w[0].isdigit() and len(w) > 1}.isdisjoint(target)


def _explained(block: Block, groups: int) -> tuple[list[dict[int, float]], list[float]]:
    """Of each group: the share explained of each source sentence, and of the whole target."""
    shares: list[dict[int, float]] = [{} for _ in range(groups)]
    if len(block.left):
        best = np.zeros(len(block.heavy_s))
        np.maximum.at(best, block.left, block.score)
        low = block.first_s
        for g in range(groups):
            for i in range(low[g], low[g + 1]):
                if block.heavy_s[i] > 0:
                    shares[g][i - low[g]] = float(best[i] / block.heavy_s[i])
    got: list[set[int]] = [set() for _ in range(groups)]
    for k, g in enumerate(block.group.tolist()):
        got[g].update(block.word_t[block.cut[k][0] : block.cut[k][1]])
    covered = [len(got[g]) / max(1, block.n_t[g]) for g in range(groups)]
    return shares, covered


class _Near:
    """A response of the sorted order: its words, its source's words, and the rows that give it."""

    __slots__ = ("bare", "source", "words", "own", "rows", "like", "shortened")

    def __init__(self, bare: str, source: str) -> None:
        self.bare, self.source, self.rows, self.like, self.shortened = bare, source, [], 0, False
        self.words = fold(bare)
        self.own = set(fold(source))

    def begins(self) -> tuple[str, int]:
        """The first words, and the function words of the source as bits."""
        return " ".join(self.words[: DEEPEST + 1]), sum(_small[w] for w in self.own & _small.keys())

    def compare(self, other: _Near) -> None:
        """Words both begin with, one of them excepted, beyond those that their sources account for."""
        same = missed = 0
        for a, b in zip(self.words, other.words):
            if a == b:
                same += 1
            elif missed:
                break
            else:
                missed = 1
        if same >= TEMPLATE and self.source != other.source:
            shared = self.own & other.own
            small = len(shared & _languages["en"])
            like = same - STANDS_FOR[0] * (len(shared) - small) - STANDS_FOR[1] * small
            self.like, other.like = max(self.like, like), max(other.like, like)


def _compared(rows: Iterator[tuple]) -> Iterator[_Near]:
    """The distinct responses of ``rows`` (entry_id, s, bare, tail), which come sorted by bare text, last first.

    In this order what continues a text stands right before it, so it is compared with the last
    different one; and with NEAR on either side for what they have in common.
    """
    held: list[_Near] = []
    longer = ""  # the last text that differs from the one at hand
    for row in rows:
        _, source, bare, _ = row
        if held and (mine := next((n for n in held if n.bare == bare and n.source == source), None)):
            mine.rows.append(row)
            continue
        here = _Near(bare, source)
        here.rows.append(row)
        if held:
            longer = held[-1].bare if held[-1].bare != bare else longer
            here.shortened = longer.startswith(bare)
        for other in held:
            here.compare(other)
        held.append(here)
        if len(held) > NEAR:
            yield held.pop(0)
    yield from held


_MARKED = "s string, bare string, tail string, shortened boolean, template boolean, head string, small long, part int, at_edge boolean"


def neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` (entry_id, s, t) with the marks ``shortened`` and ``template`` of the sorted responses, their ``head``
    and ``small``.

    ``t`` comes as ``bare`` and ``tail``, its closing dots and blanks. All rows are sorted over range
    partitions by text and entry, so that equal texts, however many, are spread; the rows at the edges
    of the partitions, a few of each, are compared once more with those across the edge, and what a text
    there goes on in holds for all rows of that text. A null and a blank text has no neighbours. ``head``
    are the first words and ``small`` the function words of the source as bits, by which ``begins_alike`` searches.
    """
    kind = rows.schema["entry_id"].dataType.simpleString()
    bare = F.coalesce(F.rtrim("t", F.lit(TAIL)), F.lit(""))
    split = rows.select("entry_id", "s", bare.alias("bare"), F.when(F.col("t").isNotNull(), F.substr("t", F.length(bare) + 1)).alias("tail"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def marked(near: _Near, part: int, at_edge: bool) -> list[tuple]:
        marks = near.shortened, near.like >= TEMPLATE, *near.begins()
        return [(*row, *marks, part, at_edge) for row in near.rows]

    names = ["entry_id", "s", "bare", "tail", "shortened", "template", "head", "small", "part", "at_edge"]

    def stream(batches: Iterator[pd.DataFrame], plain: list) -> Iterator[tuple]:
        for pdf in batches:
            for row in pdf[["entry_id", "s", "bare", "tail"]].itertuples(index=False, name=None):
                if row[2]:
                    yield row
                else:
                    plain.append(row)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        found, plain, n = [], [], 0
        last: list[_Near] = []
        for near in _compared(stream(batches, plain)):
            last.append(near)
            if len(last) > NEAR:
                found += marked(last.pop(0), part, n < NEAR)
                n += 1
            if len(found) + len(plain) > 5000:
                yield pd.DataFrame([*found, *((*row, False, False, "", 0, part, False) for row in plain)], columns=names)
                found = []
                plain.clear()
        found += [row for near in last for row in marked(near, part, True)]
        yield pd.DataFrame([*found, *((*row, False, False, "", 0, part, False) for row in plain)], columns=names)

    ordered = split.repartitionByRange(tasks, "bare", "entry_id").sortWithinPartitions(F.desc("bare"), F.desc("entry_id"))
    placed = stored(ordered.mapInPandas(run, f"entry_id {kind}, {_MARKED}"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [row for near in _compared(stream(batches, [])) for row in marked(near, 0, True)]
        yield pd.DataFrame(found, columns=names)[["entry_id", "bare", "shortened", "template"]]

    # A few rows of each partition: one task compares them in their order.
    edges = placed.where("at_edge").select("entry_id", "s", "bare", "tail").repartition(1).sortWithinPartitions(F.desc("bare"), F.desc("entry_id"))
    more = stored(edges.mapInPandas(again, f"entry_id {kind}, bare string, shortened boolean, template boolean"))
    alike = more.where("template").select("entry_id").distinct().withColumn("_template", F.lit(True))
    # Equal texts of many sources may fill partitions: what is found of one at an edge holds for all.
    longer = more.where("shortened").select("bare").union(placed.where("at_edge and shortened").select("bare"))
    both = lookup_join(placed.drop("part", "at_edge"), alike, "entry_id")
    both = lookup_join(both, longer.distinct().withColumn("_shortened", F.lit(True)), "bare")
    return both.select(
        "entry_id", "s", "bare", "tail", *((F.col(c) | F.coalesce(F.col(f"_{c}"), F.lit(False))).alias(c) for c in ("shortened", "template")), "head", "small"
    )


def begins_alike(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``s``, ``bare`` of ``asked`` that follow a template, by all of ``rows`` (both s, bare, head, small).

    Two responses that begin with as many equal words, one excepted, have so many first words in common or
    all but one of one more, so each has a key for either. Every function word that the sources share asks for
    one more equal word, so only pairs that have those are compared. Only rows with a key that is asked for are moved.
    """
    word = [F.get(F.split("head", " "), F.lit(k)) for k in range(DEEPEST + 1)]

    def keyed(df: DataFrame, levels: range) -> DataFrame:
        keys = []
        for n in levels:
            for m, least in [(None, n), *((m, n + 1) for m in range(n))]:
                same = [w for k, w in enumerate(word[:least]) if k != m]
                key = F.xxhash64(F.lit(n), F.lit(-1 if m is None else m), *same)
                other = F.lit(None).cast("string") if m is None else word[m]
                keys.append(F.when(F.size(F.split("head", " ")) >= least, F.struct(F.lit(n).alias("level"), key.alias("key"), other.alias("other"))))
        each = df.where("head <> ''").select("s", "bare", "head", "small", F.explode(F.array(*keys)).alias("k")).where("k is not null")
        return each.select("s", "bare", "head", "small", "k.*")

    mine = asked.select("s", "bare", "head", "small").distinct()
    first, levels = range(TEMPLATE, TEMPLATE + 1), range(TEMPLATE, DEEPEST + 1)
    near = lookup_join(keyed(rows, first), keyed(mine, first).select("key").distinct(), "key", "inner").select("s", "bare", "head", "small").distinct()
    left, right = keyed(mine, levels).drop("head"), keyed(near, levels).select("level", "key", *(F.col(c).alias(f"{c}2") for c in ("s", "bare", "small", "other")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[tuple[str, str], _Near] = {}
            for s, bare, s2, bare2 in pdf.itertuples(index=False, name=None):
                a, b = (known.get(x) or known.setdefault(x, _Near(x[1], x[0])) for x in ((s, bare), (s2, bare2)))
                if a.like < TEMPLATE:
                    a.compare(b)
            # A response may have been marked as the other one of a pair, too: that is as true.
            found = [x for x, near in known.items() if near.like >= TEMPLATE]
            yield pd.DataFrame(found, columns=["s", "bare"])

    asks = F.least(F.lit(TEMPLATE) + F.bit_count(F.col("small").bitwiseAND(F.col("small2"))), F.lit(DEEPEST))
    pairs = left.join(right, ["level", "key"]).where((F.col("s") != F.col("s2")) & (F.col("level") == asks) & (F.col("other").isNull() | (F.col("other") != F.col("other2"))))
    pairs = pairs.select("s", "bare", "s2", "bare2")
    return pairs.mapInPandas(run, "s string, bare string").distinct()


def limits(rows: DataFrame) -> DataFrame:
    """``size``: the lengths at which the responses ``t`` are cut off.

    Works on one row a length, combined before the shuffle; a length is compared with five on
    either side by sending its count to them. What is a spike depends on what stands around it only.
    """
    mark = F.regexp_like("t", F.lit(r"(?U)[.!?…:;][\s\"'”’»)\]*_`]*$"))
    counts = rows.where("t is not null").groupBy(F.length("t").alias("size")).agg(F.count("*").alias("n"), F.count_if(~mark).alias("open"))
    around = counts.select(F.explode(F.sequence(F.col("size") - 5, F.col("size") + 5)).alias("size"), F.col("n").alias("m"))
    means = around.groupBy("size").agg(F.sum("m").alias("m"))
    near = counts.join(means, "size").withColumn("mean", (F.col("m") - F.col("n")) / 10)
    return near.where(
        (F.col("n") - F.col("mean") > SPIKE_SIGMA * F.sqrt(F.col("mean") + 1)) & (F.col("n") > SPIKE_TIMES * F.col("mean")) & (F.col("open") >= SPIKE_OPEN * F.col("n"))
    ).select("size", F.lit(True).alias("at_limit"))


def teaches(source: str, target: str | None) -> tuple[str, str] | None:
    """The texts that words are learned from; None where the response looks like another language."""
    words = fold(target)
    if not words or sum(w in _foreign for w in words) * 12 >= len(words):
        return None
    # Quotations stay as they are and would teach foreign words.
    return _quoted.sub(" ", source), _quoted.sub(" ", target)


def broken_pairs(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``entry_id`` and ``defect`` of every entry whose rendering can't be used.

    Rows of one entry_id are one record, the one loaded last; rows without entry_id are no record. A
    null source has no rendering to judge, a null reason exempts nothing. Entries whose reason
    exempts them, and sources of few words or of names, numbers, units and codes, are no case.
    """
    word = r"[^\s\x1c-\x1f]+"
    long = F.regexp_like("source_text", F.lit(rf"(?U){word}(?:[\s\x1c-\x1f]+{word}){{{LEAST_WORDS - 1}}}"))
    case = long & ~F.coalesce(F.col("reason").isin(*EXEMPT_REASONS), F.lit(False))
    # The texts of what is no case aren't moved, but such a row may be the one that counts.
    rows = entries.select("entry_id", F.when(case, F.col("source_text")).alias("s"), F.when(case, F.col("translated_text")).alias("t"), "loaded_at")
    rows = latest(rows, "entry_id", [F.col("loaded_at")]).where("s is not null").select("entry_id", "s", "t")
    rows = neighbours(rows).withColumn("t", F.concat("bare", "tail"))
    table = train(rows.select("s", "t"), lexicon, teaches, lower=True)
    marked = lookup_join(rows.withColumn("size", F.length("t")), limits(rows), "size")
    marked = marked.select("entry_id", "s", "t", "shortened", "template", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), "head", "small")

    def run(part: pd.DataFrame, table: Table) -> pd.DataFrame:
        found, hangs = judged(part.rename(columns={"s": "source_text", "t": "translated_text"}), table)
        out = pd.DataFrame({"entry_id": part["entry_id"].to_numpy(), "defect": found})
        for c, of in (("s", part["s"]), ("bare", part["t"].str.rstrip(TAIL)), ("head", part["head"])):
            out[c] = of.where(hangs, None).to_numpy()  # of what hangs on a template alone
        out["small"] = part["small"].to_numpy()
        return out.dropna(subset=["defect", "s"], how="all")

    kind = entries.schema["entry_id"].dataType.simpleString()
    verdicts = stored(with_table(marked, table, run, f"entry_id {kind}, defect string, s string, bare string, head string, small long", ("s", "t")))
    settled, open_ = verdicts.where("s is null"), verdicts.where("s is not null")
    alike = begins_alike(open_, rows).withColumn("defect2", F.lit("refusal"))
    open_ = open_.join(alike, ["s", "bare"], "left").withColumn("defect", F.coalesce("defect2", "defect")).where("defect is not null")
    return settled.select("entry_id", "defect").union(open_.select("entry_id", "defect"))
