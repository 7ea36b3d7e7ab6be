"""License scans: identifier tags and notice phrases found by one Aho-Corasick automaton, expressions by shunting-yard.

Notice phrases are matched on words (A-Z lower-cased; runs of digits, letters a-z and everything beyond ASCII), so
punctuation and line breaks between their words don't matter. An identifier tag is followed, to the end of its
line, by an expression of license names with ``and``, ``or``, ``with`` and parentheses; ``with`` binds
closest, ``or`` least. An expression that can't be parsed gives the label ``unknown-expression``.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from parcelmart.llm.texts import per_text

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Labels of this method's own, by phrase.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
TAG = "spdx-license-identifier"
#: Names in expressions, by the first part of the name.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl",
    "bsd": "bsd", "isc": "isc", "cc0": "cc0", "unlicense": "public-domain",
}
OPEN = frozenset({"mit", "apache", "bsd", "isc", "mpl", "epl", "cc0", "cc-by", "public-domain"})
STRENGTH = {"or": 1, "and": 2, "with": 3}
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKENS = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-]*")
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postfix(tokens: list[str]) -> list[str] | None:
    """Names and operators of an expression in postfix order, or None if it is malformed."""
    out, waiting, want_name = [], [], True
    for token in tokens:
        if token == "(":
            if not want_name:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if want_name or not waiting:
                return None
            waiting.pop()
        elif token in STRENGTH:
            if want_name:
                return None
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            want_name = True
        else:
            if not want_name:
                return None
            out.append(token)
            want_name = False
    if want_name or "(" in waiting:
        return None
    return out + waiting[::-1]


def family(name: str) -> str:
    if name.startswith("cc-by"):
        return "cc-by-nc" if "-nc" in name else "cc-by-sa" if "-sa" in name else "cc-by"
    # the longest part of the name, up to a break or a digit, that is known
    ends = [m.start() for m in re.finditer(r"[-+.]|(?<=[a-z])(?=[0-9])", name)]
    return next((FAMILIES[name[:e]] for e in (len(name), *reversed(ends)) if name[:e] in FAMILIES), "other")


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """(labels, may be used under open terms) of an expression: ``or`` needs one open side, ``and`` both."""
    order = postfix(_TOKENS.findall(expression))
    if order is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token == "with":  # the exception on the right only adds rights
            stack.pop()
        elif token in STRENGTH:
            (right, right_open), (left, left_open) = stack.pop(), stack.pop()
            stack.append((left | right, left_open or right_open if token == "or" else left_open and right_open))
        else:
            label = family(token)
            stack.append(({label}, label in OPEN))
    return stack[0]


def automaton(phrases):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Scanner:
    def __init__(self):
        self.phrases = automaton([*BASE, *NOTICES, TAG.replace("-", " ")])

    def scan(self, text: str) -> tuple:
        lowered = text.translate(_A_TO_Z)
        joined = " " + _NOT_WORD.sub(" ", lowered).strip(" ") + " "
        words = joined.count(" ") - 1 if len(joined) > 2 else 0
        starts, base, own, notices, tag = [], set(), set(), 0, False
        before = counted = 0
        for end, phrase in sorted((e - len(p) - 1, p) for e, p in self.phrases.iter(joined)):
            counted += joined.count(" ", before, end)  # spaces before a phrase's own: the words before it
            before = end
            if phrase in BASE:
                starts.append(counted)
                base.add(BASE[phrase])
            elif phrase in NOTICES:
                own.add(NOTICES[phrase])
                notices += 1
            else:
                tag = True
        open_terms = None
        if tag:
            for line in lowered.split(TAG)[1:]:
                value = evaluate(line.split("\n", 1)[0].lstrip(" \t:"))
                own |= {"unknown-expression"} if value is None else value[0]
                if value is not None:
                    open_terms = value[1] if open_terms is None else open_terms and value[1]
        labels = base | own
        score = 1.0 - 0.5 ** (len(starts) + notices) if open_terms is None else 1.0
        return (words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score, open_terms)


def license_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words, places of the base phrases, labels and a score of evidence between 0 and 1 for every document.

    The score is 1 with an identifier tag whose expression can be read, else it nears 1 with each notice.
    open_terms says whether all expressions allow use under open terms (null without one).
    """

    def make():
        scanner = Scanner()

        def run(texts: list[bytes]) -> list:
            rows = [scanner.scan(t.decode("utf-8", "replace")) for t in texts]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 8

        return run

    fields = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, open_terms boolean")
    return per_text(docs, make, fields, keep)
