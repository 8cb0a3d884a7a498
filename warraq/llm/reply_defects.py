"""Broken prompt and response pairs (problem 4).

A reply is compared with the question found in its prompt (passages, labels and
instructions set aside) after both are brought to one look:

* ``copies_question``: the reply's five-word shingles that the question (said
  once or again) contains, and longest common subsequences of the rest with it,
  leave nothing of the reply but words of quoting and stray ones: a fifth of its
  words at most, no figure, and no three in a row.
* ``refusal``: every sentence or clause of the reply aligns (longest common
  subsequence, 0.8 or more) with a template of slots in ``refusals``, or with a
  courtesy that goes with one, and at least one is a refusal.
* ``other_language``: the reply's language (script, then the share of its words
  in the vocabulary of that language) isn't that of the question, or of the
  request for a language where the question makes one.
* ``truncated``: the last sentence or list item has no end; an answer of a few
  words needs none.  ``finish`` is not trusted either way.
* ``empty``: no word that could answer: nothing, unseen characters, marks,
  markup, citations alone or a bare label.

A reply may have several defects, but an empty one has no other.  A null reply is
empty; a null prompt asks nothing, so only empty and truncated can be found.
All work is per row: no shuffle but that which drops copies of an exchange.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, arrow_map, once, sent, with_rest
from .look import LookForm, answered_readings, asked_readings, by_table
from .refusals import Refusals, clauses

SHINGLE, ALIKE = 5, 0.8
#: Words that a common subsequence must have to count, and words in a row that say something.
LEAST_COMMON = 3
#: Words that a complete answer without an end mark may have at most.
FEW_WORDS = 5

# Words of quoting that copies of a question bring along.
QUOTING = set("سؤالك تسأل السؤال سؤال سألت تقول your question you ask asked asks are asking the is was question".split())
# Labels that announce an answer.
LABELS = {"الجواب", "جواب", "الإجابة", "answer", "reply", "response", "الرد"}
# How a question asks for a language.
ASKS = {
    "en": re.compile(r"(?:ب|باللغة )الإنجليزية|باللغة الانجليزية|\b(?:reply|answer|respond|write|give the answer|response)\b[^.?!\n]*\bin english\b|\bin english\b(?=[.:?,]|$)", re.I),
    "ar": re.compile(r"(?:ب|باللغة )العربية|\b(?:reply|answer|respond|write|give the answer|response)\b[^.?!\n]*\bin arabic\b|\bin arabic\b(?=[.:?,]|$)", re.I),
}
_MARKS = re.compile("[\u064b-\u0652ـ]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CITED = re.compile(r"\[\s*\d+(?:\s*[,،]\s*\d+)*\s*\]")
_FENCE = re.compile(r"```\w*|\*\*|__|^#+\s", re.M)
_ENDS = re.compile(r"[.!?؟…。](?=[\s\])»\"'”*`]|$)")
_BOUNDARY = re.compile(r"(?<=[.!?؟…])[\])»\"'”*`]*(?:\s*\[\d+\])*\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(_MARKS.sub("", text).casefold())


def question_of(prompt: str) -> str:
    """The question in a prompt of any layout: marked, or what remains without passages, labels and instructions."""
    for mark in (r"<(?:question|query)>(.*?)(?:</(?:question|query)>|$)", r"^#+ *(?:question|query|السؤال|سؤال) *:?\s*\n(.*?)(?=^#+ |\Z)", r"^(?:question|query|q|user|السؤال|سؤال) *: *(.*?)(?=\n\s*\n|^(?:passages|context|المقاطع|answer|a|assistant|الجواب|جواب) *:|\Z)"):
        if m := re.search(mark, prompt, re.S | re.M | re.I):
            if m.group(1).strip():
                return m.group(1).strip()
    kept = []
    for part in re.split(r"\n\s*\n", re.sub(r"<passages>.*?</passages>", "\n\n", prompt, flags=re.S)):
        lines = [x for x in part.split("\n") if not re.match(r"\s*(?:\[\d+\]|\d+[.)]|<p\b|</?\w+>|#+ |(?:passages|المقاطع|context)\s*:|use only|استخدم المقاطع|answer only|أجب من المقاطع)", x, re.I)]
        if any(x.strip() for x in lines):
            kept.append("\n".join(lines).strip())
    return next((k for k in kept if "?" in k or "؟" in k), kept[0] if kept else "")


def common_subsequence(a: list[str], b: list[str]) -> list[int]:
    """The places in ``a`` of a longest common subsequence with ``b``."""
    sizes = [[0] * (len(b) + 1)]
    for x in a:
        before, row = sizes[-1], [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        sizes.append(row)
    met, i, j = [], len(a), len(b)
    while i and j:
        if sizes[i][j] == sizes[i - 1][j]:
            i -= 1
        elif sizes[i][j] == sizes[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            met.append(i)
    return met[::-1]


def _word_key(word: str) -> str:
    return _MARKS.sub("", by_table(word)).casefold()


def answers(word: str) -> list[str]:
    """The keys that a rarer word answers: itself, and its beginnings."""
    w = _word_key(word)
    return ["=" + w, *answered_readings(word), *("^" + w[:i] for i in range(1, len(w)))]


class Either:
    """Membership in one of two sets."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __contains__(self, x) -> bool:
        return x in self.a or x in self.b


class Judge:
    """The defects of one exchange at a time; built once a task."""

    def __init__(self, words: list[str], refusals: Refusals | None = None):
        self.look = LookForm(words)
        self.known = {_MARKS.sub("", self.look[w]).casefold() for w in words}
        self.beginnings = {w[:i] for w in self.known for i in range(1, len(w))}
        self.refusals = refusals or Refusals()

    def also(self, rest: list[str] | None) -> Judge:
        """The judge of a vocabulary that goes on with rarer words."""
        if not rest:
            return self
        both = copy.copy(self)
        both.look = self.look.also(rest)
        more = {_word_key(w) for w in rest}
        both.known = Either(self.known, more)
        both.beginnings = Either(self.beginnings, {w[:i] for w in more for i in range(1, len(w))})
        return both

    def asks(self, prompt: str | None, text: str | None) -> set[str]:
        """The keys of rarer words that bear on an exchange, for ``common.with_rest``."""
        own = "\n".join(filter(None, map(self.look.text, (text or "").split("\n"))))
        words = words_of(own) + words_of(question_of("\n".join(map(self.look.text, (prompt or "").split("\n")))))
        last = words_of(own)[-1:]
        return {"=" + w for w in words if w not in self.known} | {"^" + w for w in last} | asked_readings([prompt, text])

    def language(self, text: str) -> str | None:
        """ar, en, other, or None where nothing tells."""
        words = [w for w in words_of(_CITED.sub(" ", text)) if w.isalpha() or "'" in w or "’" in w]
        arabic = [w for w in words if "\u0600" <= w[0] <= "ۿ"]
        latin = [w for w in words if w[0] < "ɐ"]
        if not arabic and not latin:
            return None if not words else "other"
        name, own = ("ar", arabic) if sum(map(len, arabic)) >= sum(map(len, latin)) else ("en", latin)
        if len(own) < 3 or len(own) * 2 < len(words) and len(words) > 6 and not (arabic or latin):
            return name
        return name if sum(w in self.known or len(w) == 1 for w in own) >= 0.5 * len(own) else "other"

    def empty(self, text: str) -> bool:
        left = words_of(_CITED.sub(" ", _FENCE.sub(" ", text)))
        return not left or all(w in LABELS for w in left)

    def copies(self, reply: list[str], question: list[str]) -> bool:
        """Whether a reply says no more than the question: what shingles and common subsequences leave of it is too little to say anything."""
        if not reply or not question or len(reply) < 3 and reply != question:
            return False
        own = set(question) | QUOTING
        if sum(w in own for w in reply) < ALIKE * len(reply):
            return False
        twice = question + question
        held = {tuple(twice[i : i + SHINGLE]) for i in range(len(twice) - SHINGLE + 1)}
        covered = [False] * len(reply)
        for i in range(len(reply) - SHINGLE + 1):
            if tuple(reply[i : i + SHINGLE]) in held:
                covered[i : i + SHINGLE] = [True] * SHINGLE
        # what shingles leave is aligned with the question by longest common subsequence, again and again as the question may be repeated
        rest = [i for i, c in enumerate(covered) if not c]
        while rest:
            met = common_subsequence([reply[i] for i in rest], question)
            if len(met) < min(LEAST_COMMON, len(question)):
                break
            for k in met:
                covered[rest[k]] = True
            rest = [i for i in rest if not covered[i]]
        left = [i for i in rest if reply[i] not in QUOTING]
        if sum(covered) < min(LEAST_COMMON, len(question)) or len(left) > (1 - ALIKE) * len(reply):
            return False
        # a figure, or several words in a row, that the question hasn't got say something
        row = 0
        for i in range(len(reply)):
            row = row + 1 if i in left else 0
            if row >= LEAST_COMMON or row and any(c.isdigit() for c in reply[i]):
                return False
        return True

    def refuses(self, text: str, question: str = "") -> bool:
        """Every sentence, or every clause of it, is a refusal or a courtesy, and one is a refusal."""
        refused = False
        asked = frozenset(words_of(question))
        for sentence in _BOUNDARY.split(_CITED.sub(" ", text)):
            if not (words := words_of(sentence)):
                continue
            if self.refusals.refusal(words, asked):
                refused = True
                continue
            kinds = [self.refusals.refusal(part, asked) or (None if self.refusals.courtesy(part) else False) for c in clauses(sentence) if (part := words_of(c))]
            if False in kinds:
                if not self.refusals.courtesy(words):
                    return False
            elif True in kinds:
                refused = True
        return refused

    def truncated(self, text: str) -> bool:
        body = _FENCE.sub(" ", text).rstrip()
        bare = _CITED.sub(" ", body).rstrip()
        if not bare:
            return False
        if re.search(r"(?:^|[.!?؟…:;؛\]]\s+|\n\s*)\(?(?:\d{1,2}[.)]|[-*•–])$", bare) and len(words_of(bare)) > 2:
            return True  # a list item that holds nothing
        if re.search(r"[.!?؟…][\s\])»\"'”*`]*$", bare):
            return False
        pieces = [p for p in _BOUNDARY.split(bare) if words_of(p)]
        last = words_of(pieces[-1]) if pieces else []
        if re.search(r"[\[(«،,;؛:]\s*\d*$", bare) or bare.count("(") > bare.count(")"):
            return True
        if len(pieces) > 1 or len(last) > FEW_WORDS:
            return True
        # few words: complete with a figure, or if the last one isn't the beginning of a longer word
        ended = last[-1] if last else ""
        return not (any(w[0].isdigit() for w in last) or ended in self.known or ended not in self.beginnings)

    def defects(self, prompt: str | None, text: str | None) -> list[str]:
        text = "\n".join(filter(None, map(self.look.text, (text or "").split("\n"))))
        if self.empty(text):
            return ["empty"]
        asked = "\n".join(map(self.look.text, (prompt or "").split("\n")))
        question = question_of(asked)
        found = []
        copied = self.copies(words_of(_CITED.sub(" ", text)), words_of(question))
        if copied:
            found.append("copies_question")
        if self.refuses(text, question):
            found.append("refusal")
        wanted = next((k for k, p in ASKS.items() if p.search(_MARKS.sub("", question))), None)
        ours = self.language(text)
        if question and ours and (wanted or (wanted := self.language(question))) and ours != wanted:
            found.append("other_language")
        if not copied and self.truncated(text):
            found.append("truncated")
        return found


def find(exchanges: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(exchange_id, defect) of every defective exchange of an arm."""
    own = sent(words)

    def start():
        judge = once(Judge, own)

        def work(c: dict) -> dict:
            out: dict[str, list] = {"exchange_id": [], "defect": []}
            for i, prompt, text, rest in zip(c["exchange_id"], c["prompt"], c["text"], c["rest_words"]):
                for defect in judge.also(rest).defects(prompt, text):
                    out["exchange_id"].append(i)
                    out["defect"].append(defect)
            return out

        return work

    arms = exchanges.where(F.lower("purpose").startswith("arm")).select(F.col("exchange_id").cast("long").alias("exchange_id"), "prompt", "text")

    def asks():
        judge = once(Judge, own)
        return lambda c: (judge.asks(p, t) for p, t in zip(c["prompt"], c["text"]))

    return arrow_map(with_rest(arms.dropDuplicates(["exchange_id"]), ["exchange_id"], words, asks, answers), start, "exchange_id long, defect string")
