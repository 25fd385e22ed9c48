"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

All phrases are looked for in one pass over a document's words (A-Z folded; a word is a run of ASCII letters and digits and of all characters beyond ASCII). Expressions come
from two places: what follows an ``SPDX-License-Identifier:`` tag, and names that a notice joins by ``and``, ``or`` or ``with``. An expression is turned into postfix order
(``with`` binds closest, then ``and``, then ``or``) and evaluated to whether its licences allow any use: ``or`` needs one side, ``and`` both, ``with`` its licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import ready, text_slices, word_spans

#: Phrases with fixed labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further names and their labels.
NAMES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "isc license": "isc", "zlib license": "zlib",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl", "artistic license": "artistic", "the unlicense": "unlicense",
    "creative commons attribution": "cc-by", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "public domain": "public-domain", "python software foundation license": "psf",
}
#: Words that make a name a notice, and texts that are a licence by themselves.
NOTICES = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "is licensed", "license this")
BODIES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Labels of licences that allow any use.
PERMISSIVE = frozenset("mit apache bsd isc zlib bsl unlicense cc0 public-domain psf cc-by artistic".split())
BINDING = {"or": 1, "and": 2, "with": 3}
#: First parts of identifiers and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "mpl": "mpl", "epl": "epl", "bsl": "bsl",
    "artistic": "artistic", "unlicense": "unlicense", "cc0": "cc0", "psf": "psf", "python": "psf",
}
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\n\r*#<>\"']*)", re.I)
TOKEN = re.compile(r"[A-Za-z0-9.+-]+|[()]")
#: Words that may stand between two joined names beside the joining word.
FILLERS = frozenset("the a an either both your option at version v later any gnu license licenses 1 2 3 4 0 clause new or and with of terms".split())
MOST_BETWEEN = 8


def label_of(identifier: str) -> str:
    """Label of an SPDX identifier; an unknown one is its own label."""
    x = identifier.lower().rstrip("+")
    if m := re.match(r"cc-by((?:-(?:nc|nd|sa))*)", x):
        return "cc-by" + m[1]
    return IDENTIFIERS.get(re.split(r"[-.]", x)[0], x)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if the expression is malformed."""
    out, held, operand = [], [], True
    for t in tokens:
        op = t.lower()
        if op in BINDING:
            if operand:
                return None
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[bool, list[str]]:
    """Whether the expression allows any use, and the labels of its licences (exceptions behind ``with`` have none)."""
    stack: list[tuple[bool, list[str]]] = []
    for t in rpn:
        if t in BINDING:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else (a[0] or b[0], a[1] + b[1]) if t == "or" else (a[0] and b[0], a[1] + b[1]))
        else:
            stack.append((label_of(t) in PERMISSIVE, [label_of(t)]))
    return stack[0]


def tag_tokens(line: str) -> list[str]:
    """Tokens of the expression at the start of a tag's line: up to two operands in a row, where prose begins."""
    out: list[str] = []
    for t in TOKEN.findall(line):
        plain = t.lower() not in BINDING and t not in "()"
        if plain and out and (out[-1] == ")" or out[-1].lower() not in BINDING and out[-1] not in "()"):
            break
        out.append(t)
    return out


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("name", NAMES), ("body", BODIES), ("notice", dict.fromkeys(NOTICES, "")), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    a.make_automaton()
    return a


_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_GAP = np.frombuffer(_FOLD, np.uint8) == 32


def outermost(names: list[tuple]) -> list[tuple]:
    """Names (first word, words, ...) by place that don't lie inside a longer one: such a one says nothing of its own, except as a base label. One sweep."""
    order = sorted(range(len(names)), key=lambda i: (names[i][0], -names[i][1]))
    reach, held, group, out = -1, -1, None, []
    for i in order:
        start, size = names[i][:2]
        if (start, size) != group:  # equal places don't hide each other
            reach, group = max(reach, held), (start, size)
        if reach < start + size:
            out.append(i)
        held = max(held, start + size)
    return [names[i] for i in sorted(out)]


def scan_words(found: list[tuple[int, tuple]], text: str, raw: str) -> dict:
    """Result of one document from its matches (end position in ``text``, value); ``text`` is the words between single spaces."""
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    number = np.searchsorted(spaces, [e + 1 - v[2] for e, v in found]).tolist()
    places = sorted((at, words, kind, label) for at, (_, (kind, label, _, words)) in zip(number, found))
    base = [p for p in places if p[2] == "base"]
    outer = outermost([p for p in places if p[2] in ("base", "name")])
    bodies = [p for p in places if p[2] == "body"]
    labels = {p[3] for p in base + outer + bodies}
    notices = sorted(q[0] + q[1] for q in places if q[2] == "notice")
    notice = any(bisect_right(notices, p[0]) > bisect_left(notices, p[0] - 3) for p in outer) if notices else False
    expressions = []
    if any(p[2] == "tag" for p in places):
        expressions += [x for m in TAG_LINE.finditer(raw) if (x := postfix(tag_tokens(m[1])))]
    tagged = bool(expressions)
    words = text.split(" ")[1:-1] if len(outer) > 1 else []
    for p, q in zip(outer, outer[1:]):
        between = words[p[0] + p[1] : q[0]]
        joins = [w for w in between if w in BINDING]
        if joins and len(between) <= MOST_BETWEEN and FILLERS.issuperset(between):
            expressions.append([p[3], q[3], joins[0]])
    results = [evaluate(x) for x in expressions]
    labels |= {x for _, more in results for x in more}
    allowed = all(ok for ok, _ in results) if results else all(x in PERMISSIVE for x in labels) if labels else None
    strength = 1.0 if tagged or any(b[3] != "proprietary" for b in bodies) else 0.9 if outer and notice else 0.6 if outer else 0.3 if labels else 0.0
    starts = [p[0] for p in base]
    return {
        "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted({p[3] for p in base})),
        "labels": ",".join(sorted(labels)), "expression": ";".join(" ".join(x) for x in expressions), "permissive": allowed, "score": strength,
    }


NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "expression": "", "permissive": None, "score": 0.0}
FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "expression": pa.string(), "permissive": pa.bool_(), "score": pa.float64(),
}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expression, permissive, score``.

    ``n_base`` counts all places of the base phrases and ``first_word`` and ``last_word`` are their smallest and largest first words (NULL if none). ``labels`` also holds
    what other names, licence bodies and expressions tell. ``permissive`` is NULL without a label. The score is 1 for a parsed tag or a licence body, 0.9 for a name in a
    notice, 0.6 for a name alone, 0.3 for a reservation of rights, else 0. NULL and empty texts have no words. NULL keys and repeated rows pass through.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = automaton()
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                first = word_spans(raw, offsets, _GAP)[2]
                data, out = raw.tobytes(), []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    words = f" {b' '.join(data[a:b].translate(_FOLD).split()).decode('utf-8', 'replace')} "
                    found = list(machine.iter(words))
                    out.append(scan_words(found, words, data[a:b].decode("utf-8", "replace")) if found else NOTHING)
                columns = [pa.array([x[c] for x in out], t) for c, t in list(FIELDS.items())[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(out)), pa.array(np.diff(first)), *columns], names=["doc_id", *FIELDS])

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expression string, permissive boolean, score double"
    )
