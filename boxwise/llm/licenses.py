"""Licence scans: Dice coefficient over word bigrams, in DataFrame functions alone.

Units are the lines of a text, and the whole text where it has several lines. A unit is
lower-cased, and whatever is no letter or digit parts words. A unit and a template
have Dice 2 |A and B| / (|A| + |B|) over their sets of bigrams; at least THRESHOLD can
be reached only if |A| is within bounds that |B| gives, so templates of other sizes
are passed over. The same bounds say how many of a template's bigrams, and so how many
of its words, a match must have: texts, and then units, without them are left out before
any bigram is made. Templates are literals of the plan: no join and no shuffle.

license_notices looks at runs of words instead of lines, so that it finds a notice
wherever lines break and whatever stands around it, against more templates.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import text_table

THRESHOLD = 0.75

#: Notices as their licences word them.
TEMPLATES = {
    "mit_line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "apache_2_line": "Licensed under the Apache License, Version 2.0.",
    "apache_2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl_3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd_3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl_2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc_by_4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_MEANT = {"by": "Attribution", "by_nc": "Attribution-NonCommercial", "by_sa": "Attribution-ShareAlike", "by_nd": "Attribution-NoDerivatives", "by_nc_sa": "Attribution-NonCommercial-ShareAlike", "by_nc_nd": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES |= {f"cc_{k}_line": f"Licensed under CC {k.replace('_', '-').upper()} 4.0." for k in _MEANT}
TEMPLATES |= {f"cc_{k}_4": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _MEANT.items()}

_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CLAUSES = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "

#: Templates of license_notices: also whole texts.
NOTICES = TEMPLATES | {
    "mit_text": TEMPLATES["mit"] + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd_2_text": TEMPLATES["bsd_3"] + _CLAUSES + _DISCLAIMER,
    "bsd_3_text": TEMPLATES["bsd_3"] + _CLAUSES + _THIRD + _DISCLAIMER,
}


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """The distinct word bigrams of each template, in order."""
    found = {}
    for name, text in templates.items():
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        found[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
    return found


def _array(values: list[str]) -> Column:
    """A literal array of bigrams, which hold letters, digits and a space alone."""
    return F.expr(f"array({', '.join(map(repr, values))})")


def asked_for(own: list[str], threshold: float) -> int:
    """How many of a template's bigrams a unit must have at least: with c common ones the unit has c bigrams or more, so Dice is at most 2 c / (c + |own|)."""
    return ceil(len(own) * threshold / (2 - threshold) - 1e-9)


def words_of(text: str) -> str:
    """SQL for the words of a text column: runs of ASCII letters and digits, A-Z lowered.

    The Kelvin sign and the dotted capital I are the only others whose lower case has ASCII
    letters, so they go first; then lower() does for A-Z, much faster than translate().
    """
    plain = f"replace(replace({text}, '\u212a', ' '), '\u0130', ' ')"
    return f"split(trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ')), ' ')"


def words_asked_for(own: list[str], threshold: float) -> tuple[list[str], int]:
    """The words of a template, and how many of them a match must have.

    A word is at one end or the other of so many bigrams; so many words are needed to be
    at both ends of all that a match must have.
    """
    degree = Counter(w for b in own for w in b.split())
    ends = accumulate(sorted(degree.values(), reverse=True))
    return list(degree), next(k for k, n in enumerate(ends, 1) if n >= 2 * asked_for(own, threshold))


def may_match(words: str, templates: dict[str, list[str]], threshold: float) -> Column:
    """Whether an array of words may match one of the templates: false only if it does not. Two lookups for each word, and small sets after them."""
    asked = [words_asked_for(own, threshold) for own in templates.values()]
    literal = lambda ws: f"array({', '.join(map(repr, ws))})"
    each = " or ".join(f"size(array_intersect(w, {literal(ws)})) >= {n}" for ws, n in asked)
    every = literal(sorted({w for ws, _ in asked for w in ws}))
    least = min(n for _, n in asked)
    # Inside of exists() the common words are found once.
    return F.expr(f"exists(array(array_intersect({words}, {every})), w -> size(w) >= {least} and ({each}))")


def license_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each unit and template that match: doc_id, line (from 0; -1: the whole text), template, n_bigrams, dice.

    Null and empty texts, and units of fewer than two words, match nothing; rows that
    repeat match each; a null doc_id stays null; an empty table gives no rows. Letters
    past ASCII part words.
    """
    templates = template_bigrams()
    likely = text_table(docs).where(may_match(words_of("text"), templates, threshold))
    lines = F.split("text", "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.col("text")), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    rows = likely.select("doc_id", F.posexplode(units).alias("line", "unit")).select("doc_id", (F.col("line") - 1).alias("line"), F.expr(words_of("unit")).alias("words"))
    split = rows.where(may_match("words", templates, threshold)).where(F.size("words") > 1)
    bigrams = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b)))
    every = _array(sorted({b for own in templates.values() for b in own}))
    some = split.select("doc_id", "line", bigrams.alias("bigrams")).where(F.arrays_overlap("bigrams", every))
    scored = []
    for name, own in templates.items():
        n = F.size("bigrams")
        fits = (n >= len(own) * threshold / (2 - threshold)) & (n <= len(own) * (2 - threshold) / threshold)
        dice = 2 * F.size(F.array_intersect("bigrams", _array(own))) / (n + len(own))
        scored.append(F.when(fits, F.struct(F.lit(name).alias("template"), n.alias("n_bigrams"), dice.alias("dice"))))
    found = some.select("doc_id", "line", F.inline(F.filter(F.array(*scored), lambda x: x.isNotNull())))
    return found.where(F.col("dice") >= threshold)


def license_notices(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each run of words that matches a template: doc_id, first_word (from 0), n_words, template, n_bigrams, dice.

    All runs that begin and end with a bigram of the template, and have no more bigrams,
    repeats counted, than its size bound, are compared; of those that overlap, the one of
    the highest Dice stays, the first and then the shortest of equal ones. Only texts with
    the share of a template's bigrams that the threshold asks for are looked at in this
    way. Odd rows are as in license_matches.
    """
    templates = template_bigrams(NOTICES)
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    every = _array(sorted({b for own in templates.values() for b in own}))
    likely = text_table(docs).where(may_match(words_of("text"), templates, threshold))
    split = likely.select("doc_id", F.expr(words_of("text")).alias("words")).where(F.size("words") > 1).select("doc_id", pairs.alias("pairs"))
    shared = split.withColumn("shared", F.array_intersect("pairs", every)).where(F.size("shared") > 0)
    # Dice is at least the threshold only if so large a part of the template is in the text.
    asked = [F.when(F.size(F.array_intersect("shared", _array(own))) >= asked_for(own, threshold), F.struct(F.lit(name).alias("template"), _array(own).alias("own"))) for name, own in templates.items()]
    likely = shared.select("doc_id", "pairs", F.inline(F.filter(F.array(*asked), lambda x: x.isNotNull())))
    # For each bigram the place of the same one before it: sorted by bigram and place, neighbours are compared, and sorted back.
    by_bigram = "array_sort(transform(pairs, (b, i) -> named_struct('b', b, 'i', i)))"
    earlier = "transform(array(named_struct('s', {0})), x -> transform(x.s, (e, k) -> named_struct('i', e.i, 'earlier', if(k > 0 and x.s[k - 1].b = e.b, x.s[k - 1].i, -1))))[0]"
    places = f"transform(zip_with(pairs, array_sort({earlier.format(by_bigram)}), (b, e) -> named_struct('b', b, 'e', e.earlier)), p -> named_struct('earlier', p.e, 'own', array_contains(own, p.b)))"
    # Runs from a: a bigram counts where it is the run's first of its kind, so numbers run on and no run is built.
    most = f"cast(ceil(size(own) * {(2 - threshold) / threshold!r}D) as int)"
    dice = "2D * (acc.s + x.s) / (acc.d + x.d + size(own))"
    run = "named_struct('least', -x.dice, 'first', a, 'last', acc.k, 'n', acc.d + x.d)"
    step = f"transform(array(named_struct('d', int(p.earlier < a), 's', int(p.earlier < a and p.own))), x -> transform(array(named_struct('d', x.d, 's', x.s, 'dice', {dice})), x -> named_struct('k', acc.k + 1, 'd', acc.d + x.d, 's', acc.s + x.s, 'out', if(p.own and x.dice >= {threshold!r}D, array_append(acc.out, {run}), acc.out)))[0])[0]"
    start = "named_struct('k', a, 'd', 0, 's', 0, 'out', cast(array() as array<struct<least:double,first:int,last:int,n:int>>))"
    # z binds the places, so that no rewriting of the plan works them out for each run.
    runs = f"transform(array(named_struct('at', {places})), z -> flatten(transform(filter(sequence(0, size(z.at) - 1), i -> z.at[i].own), a -> aggregate(slice(z.at, a + 1, {most}), {start}, (acc, p) -> {step}, acc -> acc.out))))[0]"
    best = likely.select("doc_id", "template", F.array_sort(F.expr(runs)).alias("runs"))
    none = F.array().cast("array<struct<least:double,first:int,last:int,n:int>>")
    # Words, not bigrams, must be apart: a run's last bigram begins one word before its last word.
    kept = F.aggregate("runs", none, lambda kept, r: F.when(F.exists(kept, lambda k: (r["first"] <= k["last"] + 1) & (k["first"] <= r["last"] + 1)), kept).otherwise(F.concat(kept, F.array(r))))
    rows = best.select("doc_id", "template", F.explode(kept).alias("r"))
    return rows.select("doc_id", F.col("r.first").alias("first_word"), (F.col("r.last") - F.col("r.first") + 2).alias("n_words"), "template", F.col("r.n").alias("n_bigrams"), (-F.col("r.least")).alias("dice"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for license_matches over documents."""
    templates = ", ".join(f"('{name}', [{', '.join(repr(b) for b in own)}])" for name, own in template_bigrams().items())
    return f"""
        WITH templates(template, own) AS (VALUES {templates}),
        lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        units AS (
            SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS unit FROM lines
            UNION ALL SELECT doc_id, -1, text FROM lines WHERE len(ls) > 1),
        worded AS (SELECT doc_id, line, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
        grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
        pairs AS (SELECT doc_id, line, template, len(g) AS n, len(own) AS m, len(list_intersect(g, own)) AS common FROM grams, templates WHERE list_has_any(g, own))
        SELECT doc_id, CAST(line AS INT) AS line, template, CAST(n AS INT) AS n_bigrams, 2.0::DOUBLE * common / (n + m) AS dice
        FROM pairs WHERE 2.0::DOUBLE * common / (n + m) >= {threshold}"""
