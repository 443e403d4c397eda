"""Problem 2: personal information inside free text.

Bootstrapped extraction. A first pass over the corpus collects candidates (capitalised words, runs of digits, what may be an
address of a house or of a mailbox) with the lexical patterns around and within them: the words before and behind, the ending of
a word, the last part of a host, how a number is joined to a street. Spark scores the graph of patterns and instances (words,
shapes of numbers, types of streets, ways of writing an at-sign) by turns, starting from seeds (hinted names, shapes that are
certain, plain mail addresses, types of streets): a pattern is as good as its instances, an instance as good as its patterns. A
second pass reads every text again; confident patterns and instances decide what is accepted, and find names, streets and
forms that no list has. The graph has no bound, so it is not broadcast: texts are dealt to buckets, and each is given the scores
of the patterns and instances its own texts hold. Positions are those of the stored text, whatever its odd characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.llm import buckets as B
from pergamin.llm import scanned
from pergamin.llm.lookalike import LIGATURES, mapping
from pergamin.session import spread, write_through

KINDS = ("email", "phone", "id_number", "address", "name")
#: Rounds of scoring; score of high confidence; occurrences from which on a pattern or an instance is trusted, whatever the corpus.
ROUNDS, CONFIDENT, COUNT = 4, 0.6, 4

# Words of streets, of parts of an address, of firms and offices, and labels printed on identity cards.
STREETS = "Rua|R|Avenida|Av|Aven|Travessa|Trav|Tv|Alameda|Al|Praça|Praca|Pça|Pca|Rodovia|Rod|Estrada|Estr|Largo|Lgo|Viela|Beco|Ladeira|Calle|Carrera|Plaza|Street"
PARTS = "apto|apartamento|ap|sala|bloco|bl|casa|fundos|lote|quadra|loja|conjunto|conj|cj|andar|sobrado|galpão|piso|unidade|torre|térreo"
FIRMS = (
    "banco clínica fundação hospital construtora transportes comercial cooperativa associação seguradora editora irmãos companhia empresa indústria comarca vara tribunal câmara juízo cartório secretaria prefeitura município colégio escola "
    "instituto universidade sociedade grupo igreja paróquia fórum estado rua avenida travessa alameda praça rodovia estrada largo bairro vila jardim parque chácara centro cidade santa santo são nova porto barra lagoa monte campo serra ribeirão águas edifício condomínio"
).split()
FIRM_ENDS = re.compile(r"\s*(?:&|S[./]?\s?[AS]\b|Ltda|EIRELI|ME\b|Cia\b|S/S)", re.I)
LABELS = "validade nacional nome do portador numero do cadastro orgao emissor emissao observacoes observacoe via unica unic impressao digital digita foto local de nasc nas grupo sanguineo categoria rubrica do chefe pai mae filiacao registro geral assinatura titular doc identidade data nascimento republica federativa".split()
TITLES = {"dr", "dra", "sr", "sra", "srta", "prof", "profa", "doutor", "doutora", "senhor", "senhora", "mr", "mrs", "ms", "don", "doña", "lic"}
PARTICLES = {"da", "de", "do", "das", "dos", "e", "y", "del", "la", "di", "von", "van"}
NO_WIDTH = frozenset(chr(c) for c in (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0x034F, 0x061C, 0x180E))

D = r"[\dOoIlSB]"
AT = r"(?:\s{0,2}@\s{0,2}|\s?[\[({]\s?(?:at|arroba)\s?[\])}]\s?|\s+(?:arroba|at)\s+)"
# Last parts of host names, for those that a line break or a blank parts from the rest.
TLD = r"(?:example|test|invalid|localhost|com|org|net|gov|edu|jus|adv|info|br|es|pt|uk)"
DOT = r"(?:\.(?=[^\W\d_])|\s?[\[({]\s?(?:dot|ponto|punto)\s?[\])}]\s?|\s+(?:ponto|punto|dot)\s+|\s?\.\s{0,2}(?=" + TLD + r"\b)|-?\n\.?(?=" + TLD + r"\b))"
LOCAL = r"[^\W](?:[\w+-]|\.(?=[\w+-])|\s?[\[({]\s?(?:dot|ponto|punto)\s?[\])}]\s?|\s(?:ponto|punto|dot)\s)*"
AT_HINT = re.compile(r"@|arroba|[\[({]\s?at\s?[\])}]|\sat\s", re.I)
HOST = re.compile(rf"[\s\])}}]{{0,4}}[^\W_][\w-]*(?:{DOT}[^\W\d_][\w-]*)+", re.I)
EMAIL = re.compile(rf"(?<![\w.+@-]){LOCAL}{AT}[^\W_][\w-]*(?:{DOT}[^\W\d_][\w-]*){{1,4}}", re.I)
PHONE = re.compile(rf"(?<![\w.,/-])(?:\+\s?{D}{{2,3}}[\s.-]*)?(?:\(\s?{D}{{2,3}}\s?\)|0\s?xx\s?{D}{{2}}|0?{D}{{2}})[\s.-]{{0,3}}{D}{{4,5}}(?:\s?[-–.]\s?|\s){D}{{4}}(?![\w/]|[-.,]\d)|(?<![\w.,/-])\+{D}{{12,13}}(?!\w)|(?<![\w.,/-])\(\s?{D}{{2,3}}\s?\)\s?{D}{{8,9}}(?!\w)")
ISSUER = r"(?:\s*[-–,]?\s*(?:SSP|DETRAN|IFP|PC|PM|MTE|OAB|CRM|CREA|[A-Z]{3,6})\s?[/-]\s?[A-Z]{2}\b)"
CPF = rf"{D}{{3}}([. ]?\s?){D}{{3}}\1{D}{{3}}\s?(?:[-/–]\s?|\1){D}{{2}}"
ID = re.compile(rf"(?<![\w.,/+-])(?:{CPF}(?![\w/]|[-.,]\d)|{D}{{1,2}}\s?\.\s?{D}{{3}}\s?\.\s?{D}{{3}}(?:\s?[-–]\s?[\dXxOIl])?(?![\w/]|[-.,]\d){ISSUER}?|{D}{{7,9}}\s?[-–]\s?[\dXx](?!\w){ISSUER}?|[A-Z]{{2}}\s?\d{{6}}(?!\w)|{D}{{7,9}}{ISSUER})")
CEP = rf"(?:C\.?E\.?P\.?\s*[:.]?\s*)?{D}{{2}}\.?{D}{{3}}\s?[-–]\s?{D}{{3}}(?!\d)"
CAP = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?"
SHORTENED = r"(?i:(?:prof|profa|dra?|cel|gen|mal|st[ao]|pe|eng|des|min|sen|dep|gov|pres|alm|brig|cap|ten|sgt|mons|n\.?\s?s|s|vis|bar)\.)"
SMALL = r"(?:(?i:d[aeo]s?|del|las?|los)|[ey]|em|na|no)"
NAMES = rf"{CAP}(?:\s+(?:(?:{SMALL})\s+)*{CAP}){{0,6}}"
STREET_WORD = re.compile(rf"\s*(?:{SMALL}(?=\s)|{SHORTENED}|{CAP}|\d{{1,2}}(?=\sde\s))")
NUMBER = re.compile(rf"\s*[,–-]?\s*(?:n(?:[ºo°.]|\.º|úmero|um)?\.?\s*)?(s\s?/\s?n\b(?!\w)|(?=\w*\d){D}{{1,5}}(?:\s?-\s?[A-Z]\b)?(?![\w]|[./-]\d)|km\s\d+)", re.I)
GAP = re.compile(r"\s*[,–-]\s*(?:-\s*)?|\s+(?=C\.?E\.?P)|\s?/\s?", re.I)
CEP_PART = re.compile(CEP, re.I)
PART = re.compile(rf"(?:{PARTS})\b\.?\s*(?:\d{{1,4}}\w?\b|[A-Z]\b)?", re.I)
PLACE = re.compile(NAMES)
STREET = re.compile(rf"(?<![\w@.])(?:(?i:{STREETS})\.?(?=\s)|{CAP}\.?(?=\s+(?:{SMALL}\s+)*{CAP}))")
STATE = re.compile(r"[A-Z]{2}(?!\w)")
WORD = re.compile(r"[^\W\d_](?:[^\s,.;:()|\"“”/@\d\[\]]*[^\W_])?")
CODE = re.compile(r"[-/]?\d")
TOKEN = re.compile(r"[^\W_]+(?:[.\-/'’&][^\W_]+)*|[^\w\s]")
STEMS = re.compile(r"\d")


def shadow(text: str) -> tuple[str, list[int] | None]:
    """The text in the characters it looks like, without those of no width, and the position of each in the text (None: same)."""
    if text.isascii() or not ODD.search(text):
        return text, None
    if not RESIZED.search(text):
        return text.translate(TABLE), None
    out: list[str] = []
    at: list[int] = []
    last = 0
    for m in RESIZED.finditer(text):
        k, c = m.start(), m.group()
        out.append(text[last:k].translate(TABLE))
        at.extend(range(last, k))
        last = k + 1
        if c in NO_WIDTH or c == "\xad" and text[last : last + 1].isalnum():
            continue
        if "\u0300" <= c <= "\u036f" and at:
            before = next(x for x in reversed(out) if x)
            joined = unicodedata.normalize("NFC", before[-1] + c)
            if len(joined) == 1:
                out.append("")
                place = next(j for j in range(len(out) - 1, -1, -1) if out[j])
                out[place] = before[:-1] + joined
                continue
        letters = LIGATURES.get(c) or TABLE.get(ord(c), c)
        out.append(letters)
        at.extend([k] * len(letters))
    out.append(text[last:].translate(TABLE))
    at.extend(range(last, len(text)))
    return "".join(out), at


# Characters that are not one character of what they look like: of no width, accents of the letter before, ligatures.
RESIZED = re.compile(f"[\u0300-\u036f\xad{''.join(sorted(NO_WIDTH))}{''.join(LIGATURES)}]")
ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xff–—“”‘’•…]|\xad")
TABLE = str.maketrans(dict(zip(*mapping())))


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not "̀" <= c <= "ͯ")


@dataclass
class Knowledge:
    """What the second pass knows, of a bucket: common words, hinted names, and scores of patterns and instances."""

    common: set[str] = field(default_factory=set)
    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    patterns: dict[tuple[str, str], float] = field(default_factory=dict)
    intro: set[str] = field(default_factory=set)  # words that only open sentences
    instances: dict[tuple[str, str], float] = field(default_factory=dict)

    def __post_init__(self):
        self.given_ends = Counter(w[-n:] for w in self.given for n in (3, 4))
        self.family_ends = Counter(w[-n:] for w in self.family for n in (3, 4))
        self.folded: dict[str, str] = {}
        self.kinds: dict[str, tuple[str, int]] = {}

    def fresh(self) -> Knowledge:
        return Knowledge(set(), self.given, self.family)

    def add(self, batch: pa.RecordBatch) -> None:
        """Entries (kind, item, score) of a bucket."""
        for kind, item, score in zip(*(batch.column(c).to_pylist() for c in ("kind", "item", "score"))):
            if kind == COMMON:
                if item not in self.given and item not in self.family:
                    self.common.add(item)
            elif kind == INTRO:
                if item not in self.given and item not in self.family:
                    self.intro.add(item)
            elif kind[0] == "=":
                self.instances[kind[1:], item] = score
            else:
                self.patterns[kind, item] = score

    def kind_of(self, word: str) -> tuple[str, int]:
        """A word folded, and whether it may be part of a name, is a particle or neither."""
        found = self.kinds.get(word)
        if found is None:
            if len(self.kinds) > 300_000:
                self.kinds.clear()
            folded = fold(word)
            kind = PARTICLE if folded in PARTICLES else OTHER if folded in self.common or folded in TITLES or "-" in word or not word[0].isupper() or self.is_label(word, folded) else NAME
            found = self.kinds[word] = folded, kind
        return found

    def ends(self, word: str, counts: Counter) -> int:
        return max(counts[word[-4:]], counts[word[-3:]] // 2)

    def likeness(self, word: str) -> float:
        """How much a folded word is like a name, by itself."""
        if word in self.given or word in self.family:
            return 1.0
        if word in self.common or word in PLAIN_LABELS or len(word) < 3:
            return 0.0
        return max(self.patterns.get(("name", f"E:{word[-n:]}"), 0.0) for n in (4, 5))

    def is_label(self, word: str, folded: str) -> bool:
        """A label of a card, whole or clipped by up to two letters."""
        if folded in PLAIN_LABELS:
            return True
        return word.isupper() and len(folded) > 1 and folded in CLIPPED_LABELS and folded not in self.given and folded not in self.family

    def is_given(self, word: str) -> bool:
        if word in self.given:
            return True
        return word not in self.family and self.ends(word, self.given_ends) > self.ends(word, self.family_ends)

    def around(self, kind: str, patterns: list[str]) -> float:
        return max((self.patterns.get((kind, p), 0.0) for p in patterns), default=0.0)


COMMON, INTRO = "common", "intro"
OTHER, NAME, PARTICLE = range(3)
PLAIN_LABELS = frozenset(LABELS)
CLIPPED_LABELS = frozenset(x[:-k] for x in LABELS for k in (1, 2) if len(x) > k)
FIRM_WORDS = frozenset(map(fold, FIRMS))


def context(clean: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two tokens before and behind, digits masked; the start of a text is a token. No token is cut, however long."""
    width, before = 32, []
    while True:
        found = list(TOKEN.finditer(clean, max(0, start - width), start))
        if start <= width or len(found) > 2 or len(found) == 2 and found[0].start() > start - width:
            before = [m.group() for m in found[-2:]]
            break
        width *= 4
    behind = [m.group() for m, _ in zip(TOKEN.finditer(clean, end), range(2))]
    return [STEMS.sub("9", t.lower()) for t in before] or ["^"], [STEMS.sub("9", t.lower()) for t in behind] or ["$"]


def patterns_of(clean: str, start: int, end: int) -> list[str]:
    before, behind = context(clean, start, end)
    return [f"L:{' '.join(before)}", f"R:{' '.join(behind)}"]


BREAKS = r"\s,.;:()|\"“”/@\d\[\]"
CAPITAL = re.compile(rf"(?<!\w)(?<!\w[^{BREAKS}\w])[^\W\d_a-zß-öø-ÿ](?:[^{BREAKS}]*[^\W_])?")
PARTICLES_GAP = re.compile(rf"\s+(?:(?:{'|'.join(sorted(PARTICLES))})\s+)+", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def capital_runs(clean: str, knowledge: Knowledge) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of words that may be parts of a name: (start, end, folded), with particles, initials and a comma in between."""
    run: list[tuple[int, int, str]] = []
    last = 0
    for m in CAPITAL.finditer(clean):
        start, end = m.span()
        folded, kind = knowledge.kind_of(m.group())
        if run:
            gap = clean[last:start]
            small = gap.strip()
            if not small and gap.count("\n") < 2 or small == "." and run[-1][2][-1] == "." or small == "," and len(run) <= 3:
                pass
            elif gap.count("\n") < 2 and PARTICLES_GAP.fullmatch(gap):
                run.extend((last + p.start(), last + p.end(), p.group().lower()) for p in LETTERS.finditer(gap))
            else:
                yield run
                run = []
        initial = end == start + 1 and clean[end : end + 1] == "."
        if (kind == OTHER or kind == PARTICLE and not run) and not initial or CODE.match(clean, end):
            if run:
                yield run
                run = []
            continue
        if initial:
            folded += "."
        run.append((start, end, folded))
        last = end
    if run:
        yield run


def trimmed(run: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    while run and run[-1][2] in PARTICLES:
        run = run[:-1]
    while run and run[0][2] in PARTICLES:
        run = run[1:]
    return run


def shape(text: str) -> str:
    """Digits, and letters read for digits among them, as 9, other capitals as A."""
    masked = re.sub(rf"{D}*\d{D}*", lambda m: "9" * len(m.group()), re.sub(r"\s+", " ", text))
    return re.sub("[A-Z]", "A", masked)


# Shapes of numbers whose kind is certain.
CERTAIN = (("id_number", re.compile(r"999\.999\.999[-/]99")), ("id_number", re.compile(r"99?\.999\.999-[9A]|99?\.999\.999(?:-[9A])? ?[-,]? ?A+[/-]AA")), ("phone", re.compile(r"(?:\+99[ .-]?)?(?:\(99\)|\(999\)|99)[ .-]?9{4,5} ?[-. ] ?9{4}")), ("phone", re.compile(r"\+9{12,13}|9xx99 9{4,5}-9{4}")))


def certain_kind(shaped: str) -> str | None:
    return next((kind for kind, regex in CERTAIN if regex.fullmatch(shaped)), None)


def name_parts(clean: str, knowledge: Knowledge) -> Iterator[list]:
    """What may be the names of a text, and, of what opens a sentence, the same without its first words."""
    for run in capital_runs(clean, knowledge):
        for part in split_names(run, clean, knowledge):
            part = trimmed(part)
            if part:
                yield part


def edges_of(text: str, knowledge: Knowledge) -> Iterator[tuple[str, str, str]]:
    """(kind, pattern, instance) of the candidates of a text; a pattern that the second pass only may ask for has no instance."""
    clean, _ = shadow(text)
    for part in name_parts(clean, knowledge):
        around = patterns_of(clean, part[0][0], part[-1][1])
        rest = part
        while len(rest) > 1 and sentence_start(clean, rest[0][0]):
            rest = trimmed(rest[1:])
            if rest:
                yield "name", patterns_of(clean, rest[0][0], rest[-1][1])[0], ""
        for start, _, folded in part:
            if folded not in PARTICLES and len(folded) > 2 and folded.isalpha():
                yield "start", "S:1" if sentence_start(clean, start) else "S:0", folded
                yield from (("name", p, folded) for p in around)
                yield from (("name", f"E:{folded[-n:]}", folded) for n in (4, 5) if len(folded) > n)
    for kind, regex in (("phone", PHONE), ("id_number", ID)):
        for m in regex.finditer(clean):
            for p in patterns_of(clean, *m.span()):
                yield kind, p, shape(m.group())
    for start, end in emails(clean):
        for p in email_patterns(clean, start, end):
            yield "email", p, email_form(clean[start:end])
    for start, end, instance, patterns in addresses(clean, knowledge):
        yield from (("address", p, instance) for p in patterns)


EDGES = "bucket int, kind string, pattern string, instance string, n long"
_ENTRY = ["kind", "item", "score"]


class EdgeReader:
    """Reads the texts of buckets and gives the edges of their candidates, counted within every task."""

    def __init__(self, knowledge: Knowledge):
        self.knowledge = knowledge

    def __call__(self, parts: Iterator[tuple[int, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        bucket, counts, own = None, Counter(), self.knowledge.fresh()
        for at, entries, batch in parts:
            if at != bucket or len(counts) > 400_000:
                yield self.rows(bucket, counts)
                counts = Counter()
            if at != bucket:
                bucket, own = at, self.knowledge.fresh()
            if entries:
                own.add(batch)
                continue
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(edges_of(text, own))
        yield self.rows(bucket, counts)

    @staticmethod
    def rows(bucket: int | None, counts: Counter) -> pa.RecordBatch:
        kinds, patterns, instances = zip(*counts) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(counts), pa.int32()), *(pa.array(c, pa.string()) for c in (kinds, patterns, instances)), pa.array(counts.values(), pa.int64())], names=["bucket", "kind", "pattern", "instance", "n"])


def score(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores (kind, item, n, score) of patterns and of instances after some rounds over the pattern-instance graph.

    ``edges``: (kind, pattern, instance, n). ``seeds``: (kind, instance, seed), 1 for certain instances and 0 for certain other
    things. A pattern's score is the mean score of its occurrences, damped for rare ones; an instance that is no seed has the
    mean score of its patterns. Each round is written, so none repeats the one before; so should the edges be.
    """
    scores = seeds.select("kind", "instance", F.col("seed").alias("score"))
    for _ in range(rounds):
        known = edges.join(scores.select("kind", "instance", "score"), ["kind", "instance"], "left")
        patterns = known.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))) / (F.sum("n") + 1)).alias("score"))
        patterns = write_through(patterns, "patterns")
        means = edges.join(patterns.select("kind", "pattern", "score"), ["kind", "pattern"]).groupBy("kind", "instance").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"))
        scores = write_through(means.join(seeds, ["kind", "instance"], "left").select("kind", "instance", "n", F.coalesce("seed", "mean").alias("score")), "instances")
    return patterns.withColumnRenamed("pattern", "item"), scores.withColumnRenamed("instance", "item")


def seeds_of(edges: DataFrame, knowledge: Knowledge) -> DataFrame:
    """(kind, instance, seed): hinted names, words of firms, shapes of numbers that are certain, plain mail addresses, types of streets."""
    names = sorted(knowledge.given | knowledge.family)
    fixed = [("name", w, 1.0) for w in names] + [("name", w, 0.0) for w in sorted(FIRM_WORDS - set(names))] + [("email", PLAIN_EMAIL, 1.0)] + [("address", w, 1.0) for w in sorted({fold(x) for x in STREETS.split("|")})]
    seeds = edges.sparkSession.createDataFrame(fixed, "kind string, instance string, seed double")
    truth = F.lit(None).cast("string")
    for kind, regex in CERTAIN:
        truth = F.coalesce(truth, F.when(F.col("instance").rlike(f"^(?:{regex.pattern})$"), F.lit(kind)))
    shapes = edges.where(F.col("kind").isin("phone", "id_number")).select("kind", "instance").distinct().withColumn("_truth", truth).where("_truth is not null")
    return seeds.unionByName(shapes.select("kind", "instance", F.when(F.col("kind") == F.col("_truth"), 1.0).otherwise(0.0).alias("seed")))


def dealt(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows (bucket, key, text, times): each different row once, so none that is repeated makes a bucket large."""
    rows = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).groupBy("_key", "text").agg(F.count("*").alias("_times"))
    buckets = B.number_of(8 * texts.count(), texts.sparkSession.sparkContext.defaultParallelism)
    return write_through(rows.withColumn("bucket", F.pmod(F.xxhash64("_key", "text"), F.lit(buckets)).cast("int")), "texts"), buckets


def common_entries(texts: DataFrame) -> DataFrame:
    """(bucket, kind, item, score) for the words of a bucket that are, in the corpus, common in small letters."""
    counts = write_through(scanned.corpus_counts(spread(texts.select("bucket", "text")), fold), "words")
    common = scanned.totals(counts).where((F.col("n") >= COUNT + 1) & (F.col("small") >= 0.3 * F.col("n"))).select("word")
    return counts.where("kind = 0").select("bucket", "word").join(common, "word").select("bucket", F.lit(COMMON).alias("kind"), F.col("word").alias("item"), F.lit(1.0).alias("score"))


def learned(edges: DataFrame, knowledge: Knowledge) -> DataFrame:
    """(bucket, kind, item, score) for the patterns and instances of a bucket, from the graph of the whole corpus."""
    graph = write_through(edges.where("kind <> 'start' and instance <> ''").groupBy("kind", "pattern", "instance").agg(F.sum("n").alias("n")), "graph")
    patterns, instances = score(graph, seeds_of(graph, knowledge))
    trusted = (F.col("n") >= COUNT) & (F.col("score") >= CONFIDENT)
    starts = edges.where("kind = 'start'").groupBy(F.col("instance").alias("item")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pattern") == "S:1", F.col("n")).otherwise(0)).alias("opens"))
    intro = starts.where((F.col("n") >= 5 * COUNT) & (F.col("opens") >= 0.9 * F.col("n"))).select(F.lit("start").alias("kind"), "item", F.lit(1.0).alias("score"))
    asked = edges.where("kind <> 'start'").select("bucket", "kind", F.col("pattern").alias("item")).distinct().join(patterns.where(trusted).select("kind", "item", "score"), ["kind", "item"])
    held = edges.where("kind <> 'name' and instance <> ''").select("bucket", "kind", F.col("instance").alias("item")).distinct()
    forms = held.join(instances.where((F.col("n") >= COUNT) | (F.col("score") == 1)).select("kind", "item", "score").unionByName(intro), ["kind", "item"])
    forms = forms.withColumn("kind", F.when(F.col("kind") == "start", INTRO).otherwise(F.concat(F.lit("="), F.col("kind"))))
    return asked.select("bucket", *_ENTRY).unionByName(forms.select("bucket", *_ENTRY))


def find(text: str, knowledge: Knowledge) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every occurrence in the stored text, in order, without overlaps."""
    clean, at = shadow(text)
    taken: list[tuple[int, int, str]] = []

    def take(found: list[tuple[int, int, str]]) -> None:
        """Those that overlap nothing that is taken and no earlier one of theirs."""
        starts, ends = [x[0] for x in taken], [x[1] for x in taken]
        behind = 0
        for start, end, kind in found:
            k = bisect_left(starts, end)
            if start >= behind and (k == 0 or ends[k - 1] <= start):
                new.append((start, end, kind))
                behind = end
        taken.extend(new)
        taken.sort()

    for candidates in (
        ((a, b, "email") for a, b in emails(clean) if is_email(clean, a, b, knowledge)),
        ((a, b, "address") for a, b, instance, patterns in addresses(clean, knowledge, True)),
        ((*m.span(), "id_number") for m in ID.finditer(clean) if number_kind(clean, *m.span(), "id_number", knowledge)),
        ((*m.span(), "phone") for m in PHONE.finditer(clean) if number_kind(clean, *m.span(), "phone", knowledge)),
        ((a, b, "name") for a, b in names(clean, knowledge)),
    ):
        new: list[tuple[int, int, str]] = []
        take(list(candidates))
    out = []
    for start, end, kind in taken:
        out.append((kind, start, end) if at is None else (kind, at[start], at[end - 1] + 1 + trailing(text, at[end - 1] + 1)))
    return out


def emails(clean: str) -> Iterator[tuple[int, int]]:
    behind = 0
    for at in AT_HINT.finditer(clean):
        host = HOST.match(clean, at.end())
        if at.start() < behind or not host:
            continue
        start = max(behind, token_start(clean, at.start()))
        while m := SPELLED.search(clean, max(behind, start - 12), start):
            start = max(behind, token_start(clean, m.start()))
        found = EMAIL.search(clean, start, host.end())
        if found and found.start() < at.end():
            yield found.span()
            behind = found.end()


SPELLED = re.compile(r"\s?[\[({]?\s?(?:ponto|punto|dot)\s?[\])}]?\s?\Z", re.I)


def token_start(clean: str, end: int) -> int:
    """Where the token that ends at ``end``, blanks behind it aside, begins."""
    while end and clean[end - 1].isspace():
        end -= 1
    while end and not clean[end - 1].isspace():
        end -= 1
    return end


PLAIN_EMAIL = "a@a.a"


def email_form(found: str) -> str:
    """How an address is written: its signs, blanks and the words in place of signs, all else as one letter."""
    spelled = re.sub(r"\b(arroba|ponto|punto|dot|at)\b", lambda m: m.group().upper(), re.sub(r"\s+", " ", found.lower()))
    form = re.sub(r"[^\s@.\[\](){}A-Z]+", "a", spelled)
    return re.sub(r"(?:\.a)+$", ".a", re.sub(r"^a(?:\.a)+@", "a@", form))


def email_patterns(clean: str, start: int, end: int) -> list[str]:
    return [*patterns_of(clean, start, end), f"H:{re.split(r'[^a-z]+', clean[start:end].lower())[-1]}"]


def is_email(clean: str, start: int, end: int, knowledge: Knowledge) -> bool:
    """By the way it is written, the last part of the host or what stands around it."""
    known = knowledge.instances.get(("email", email_form(clean[start:end])), 0.0)
    return known >= CONFIDENT or knowledge.around("email", email_patterns(clean, start, end)) >= CONFIDENT


def trailing(text: str, k: int) -> int:
    """Accents that belong to the character before."""
    n = 0
    while k + n < len(text) and "̀" <= text[k + n] <= "ͯ":
        n += 1
    return n


def number_kind(clean: str, start: int, end: int, kind: str, knowledge: Knowledge) -> bool:
    """Whether a run of digits is of the kind: by its shape if the graph is sure of it, else by the patterns around it."""
    found = clean[start:end]
    core = re.sub(r"xx|\s*[-–,]?\s*[A-Z]{2,6}\s?[/-]\s?[A-Z]{2}$|^[A-Z]{2}(?=\s?\d{6}$)", "", found)
    if sum(c.isdigit() for c in core) < 0.7 * sum(c.isalnum() for c in core):
        return False
    shaped = shape(found)
    certain = certain_kind(shaped)
    if certain:
        return certain == kind
    before = clean[max(0, start - 24) : start].lower()
    if re.search(r"(?:processo|proc|protocolo|autos|case|expediente|cnpj|c[óo]digo|code|lote|sob n|under n|bajo el n|r\$|\$|cep)[\s.:nº°o]*$", before):
        return False
    patterns = patterns_of(clean, start, end)
    scores = {k: knowledge.around(k, patterns) for k in ("phone", "id_number")}
    if max(scores.values()) > 0:
        return scores[kind] == max(scores.values())
    if kind == "phone":
        return shaped[0] in "(+" or shaped.startswith("9xx") or bool(re.fullmatch(r"99[\s.-]+9{4,5}\s?[-. ]\s?9{4}", shaped))
    return bool(re.fullmatch(r"999[. ]999[. ]999.?.?99|9{11}|99?\.999\.999(-[9AX])?( ?[-,]? ?A+[/-]A+)?|AA9{6}|9{7,9}-[9X]", shaped.replace("- ", "-"))) and shaped != "99.999.999"


def addresses(clean: str, knowledge: Knowledge, confirmed: bool = False) -> Iterator[tuple[int, int, str, list[str]]]:
    """From what may be the type of a street to the last part of its address, with the type folded and its patterns; a street
    without a number is none. Those only that are ``confirmed`` by the knowledge, or all that may be one."""
    behind, chain_end, number, typed = 0, 0, None, -1
    for m in STREET.finditer(clean):
        if m.start() < behind:
            continue
        instance = fold(m.group().rstrip("."))
        if instance not in STREET_TYPES and knowledge.kind_of(m.group().rstrip("."))[1] != NAME or instance in knowledge.given or instance in knowledge.family:
            continue
        if m.end() >= chain_end:  # the words from here to the number, which later starts share; none is looked at twice
            end, number, words, typed = m.end(), None, 0, -1
            while True:
                number = NUMBER.match(clean, end) if words else None
                word = None if number else STREET_WORD.match(clean, end)
                if not word:
                    break
                end = word.end()
                words += 1
                if fold(word.group().strip(" .\n")) in NO_STREET:
                    typed = end
            chain_end = end
        if not number or instance not in STREET_TYPES and m.start() < typed:
            continue
        end, parts = number.end(), []
        while True:
            gap = GAP.match(clean, end)
            if not gap or gap.group().count("\n") > 1:
                break
            follow = next(((k, x) for k, x in (("cep", CEP_PART.match(clean, gap.end())), ("part", PART.match(clean, gap.end())), ("state", STATE.match(clean, gap.end())), ("place", place(clean, gap.end()))) if x and x.end() > gap.end()), None)
            if not follow:
                break
            parts.append(follow[0])
            end = follow[1].end()
        while end > m.end() and clean[end - 1] in ".,- \n":
            end -= 1
        before, _ = context(clean, m.start(), end)
        joined = re.sub(r"\s+", " ", STEMS.sub("9", number.group()[: number.start(1) - number.start()].lower()))
        patterns = [f"L:{' '.join(before)}", f"N:{joined}", f"F:{' '.join(parts)}"]
        if confirmed and not is_address(instance, patterns, parts, knowledge) or not parts and instance not in STREET_TYPES:
            continue
        if confirmed or instance in STREET_TYPES:
            behind = end
        yield m.start(), end, instance, patterns


STREET_TYPES = frozenset(fold(x) for x in STREETS.split("|"))
NO_STREET = STREET_TYPES | PLAIN_LABELS  # what lies behind one of these does not belong to what lies before


def is_address(instance: str, patterns: list[str], parts: list[str], knowledge: Knowledge) -> bool:
    """A known type of street is confirmed by being one; any other word by the graph, or by what stands before and behind it."""
    if knowledge.instances.get(("address", instance), 0.0) >= CONFIDENT or instance in STREET_TYPES:
        return True
    return len(parts) > 1 and knowledge.around("address", patterns[:1]) >= CONFIDENT and knowledge.around("address", patterns[1:]) >= CONFIDENT


def place(clean: str, at: int) -> re.Match | None:
    """A district or city: capitalised words that no full stop ends; a sentence that begins here is none."""
    m = PLACE.match(clean, at)
    if m and re.match(r"\s+[a-zà-ÿ]{3,}", clean[m.end() : m.end() + 12]) and not re.match(r"\s*[,/-]", clean[m.end() :]) and len(m.group().split()) < 2 and m.group().lower() != "centro":
        return None
    return m


def names(clean: str, knowledge: Knowledge) -> Iterator[tuple[int, int]]:
    for run in capital_runs(clean, knowledge):
        for part in split_names(run, clean, knowledge):
            part = trimmed(part)
            while part and part[0][2] in knowledge.intro and sentence_start(clean, part[0][0]):
                part = trimmed(part[1:])
            if part and is_name(part, clean, knowledge):
                yield part[0][0], part[-1][1]


def sentence_start(clean: str, at: int) -> bool:
    before = clean[max(0, at - 3) : at].rstrip()
    return not before or before[-1] in ".!?;" or "\n" in clean[max(0, at - 1) : at]


def split_names(run: list, clean: str, knowledge: Knowledge) -> Iterator[list]:
    """Parts of a run: at an "e" or a line break between two whole names, at words of firms, and at runs of two people."""
    part: list = []
    behind: list = [None] * len(run)  # the next word that is no particle
    for k in range(len(run) - 2, -1, -1):
        behind[k] = run[k + 1] if run[k + 1][2] not in PARTICLES else behind[k + 1]
    words = whole = 0  # of the part; without initials
    given = True
    for k, (start, end, folded) in enumerate(run):
        following = behind[k]
        if folded in ("e", "y") and following and words >= 2 and knowledge.is_given(following[2]) and not given:
            yield part
            part, words, whole, given = [], 0, 0, True
            continue
        gap = clean[part[-1][1] : start] if part else ""
        if "\n" in gap and whole >= 2 and knowledge.is_given(folded) and not knowledge.is_given(part[-1][2]) or "," in gap and not (knowledge.is_given(folded) and not knowledge.is_given(part[0][2])):
            yield part
            part, words, whole, given = [], 0, 0, True
        part.append((start, end, folded))
        if folded not in PARTICLES:
            words += 1
            whole += folded[-1] != "."
            given = given and knowledge.is_given(folded)
    if part:
        yield part


def is_name(part: list, clean: str, knowledge: Knowledge) -> bool:
    words = [w for _, _, w in part if w not in PARTICLES]
    whole = [w for w in words if len(w) > 2 and w[-1] != "."]
    if not whole or any(w in FIRM_WORDS for w in words) or FIRM_ENDS.match(clean, part[-1][1]):
        return False
    before, _ = context(clean, part[0][0], part[-1][1])
    if fold(before[-1]) in FIRM_WORDS or len(before) > 1 and fold(before[-2]) in ("comarca", "vara", "cidade", "municipio", "rua"):
        return False
    like = [knowledge.likeness(w) for w in whole]
    around = max(knowledge.patterns.get(("name", p), 0.0) for p in patterns_of(clean, part[0][0], part[-1][1]))
    if len(words) == 1:
        return like[0] >= 0.8 and around > 0
    strong = sum(x >= 0.6 for x in like)
    return strong * 2 >= len(like) or strong and around > 0 or around >= CONFIDENT and len(words) >= 2


FOUND = "kind string, start_pos bigint, end_pos bigint"


class FindReader:
    """Reads the texts of buckets and gives what ``find`` finds in each."""

    def __init__(self, knowledge: Knowledge, schema: pa.Schema):
        self.knowledge, self.schema = knowledge, schema

    def __call__(self, parts: Iterator[tuple[int, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        bucket, own = None, self.knowledge.fresh()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))
        for at, entries, batch in parts:
            if at != bucket:
                bucket, own = at, self.knowledge.fresh()
            if entries:
                own.add(batch)
                continue
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column("text").to_pylist()
                found = [find(t, own) if t else [] for t in texts]
                listed = [[{"kind": k, "start_pos": a, "end_pos": b} for k, a, b in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_times"), pa.array(listed, kind), pa.array([masked_text(t, f) for t, f in zip(texts, found)], pa.string())], names=["_key", "_times", "found", "masked"])


def personal_information(df: DataFrame, hints: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row for every row of ``df``: key, ``found`` (kind, start_pos, end_pos of each occurrence, by code points of the stored
    text, end exclusive) and ``masked`` (the text with each occurrence replaced by its kind in brackets).

    ``hints``: the table of hinted names (name, kind), which does not grow. A null text has nothing found and stays null. Whole
    texts are read. Null keys and repeated rows are kept; other columns are not carried.
    """
    names = [(r.name, r.kind) for r in hints.select("name", "kind").dropna().distinct().collect()]
    given, family = (frozenset(fold(p) for n, k in names if k == kind for p in n.split() if len(p) > 2) for kind in ("given", "family"))
    knowledge = Knowledge(set(), given, family)
    texts, buckets = dealt(df, key, text)
    common = write_through(common_entries(texts), "common")
    edges = write_through(B.read(common, texts.select("bucket", "text"), buckets, ["text"], [], EdgeReader(knowledge), EDGES), "edges")
    entries = common.unionByName(learned(edges, knowledge))
    item = T._parse_datatype_string(f"_times bigint, found array<struct<{FOUND.replace(' ', ':')}>>, masked string".replace(",:", ","))
    schema = T.StructType([T.StructField("_key", texts.schema["_key"].dataType), *item.fields])
    found = B.read(entries, texts, buckets, ["_key"], [], FindReader(knowledge, None), schema)
    return found.select(F.col("_key").alias(key), "found", "masked", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_times")).drop("_times")


def masked_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if not found:
        return text
    out, last = [], 0
    for kind, start, end in found:
        out.extend((text[last:start], f"[{kind.upper()}]"))
        last = end
    return "".join([*out, text[last:]])
