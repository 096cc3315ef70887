"""License scans: runs of lines compared to licence texts and notices by the Dice coefficient of their word pairs.

Text is normalised to lower-cased runs of letters and digits. A window is a run of whole lines; its
pairs are the distinct pairs of neighbouring words, across line ends too. Size bounds prune: a window
reaches the least coefficient only if it shares enough of a template's pairs, so a text that lacks all
of some words, or shares too few pairs as a whole, is dropped before any window is made, and a window
grows only while its own number of pairs allows the coefficient.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WARRANTY = "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
#: Licence texts, notices at the head of files, and sentences that name a licence in running text. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "reserved": "All rights reserved.",
    "MIT-text": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", {_WARRANTY}, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause-text": f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-notice": _GPL.replace("{n}", "2"),
    "GPL-3.0-notice": _GPL.replace("{n}", "3"),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Least Dice coefficient of a match.
LEAST_DICE = 0.8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_pairs(w: Column) -> Column:
    """Neighbouring words of an array."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def template_words(text: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def template_pairs(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def least_shared(n: int, least: float) -> int:
    """Pairs of a template of n that a window has to share: it has at least as many itself, and 2 s / (n + m) >= least."""
    return math.ceil(n * least / (2 - least) - 1e-9)


def most_pairs(n: int, least: float) -> float:
    """Pairs that a window may have itself: of them n at most are shared."""
    return n * (2 - least) / least + 1e-9


def needles(pairs: list[str], least: float) -> list[str]:
    """Long words of which a match has one: pairs without any of them are fewer than a match has to share."""
    free, out = set(pairs), []
    while len(free) >= least_shared(len(pairs), least):
        counts = {}
        for p in free:
            for w in set(p.split()):
                counts[w] = counts.get(w, 0) + 1
        out.append(max(counts, key=lambda w: (min(len(w), 8), counts[w], w)))
        free = {p for p in free if out[-1] not in p.split()}
    return out


def most_words(n: int, least: float) -> int:
    """Words of a window at most, for a template of n words: by the same share as its pairs."""
    return math.floor(n * (2 - least) / least + 1e-9)


def scan_lines(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_DICE, separator: str = "\n") -> DataFrame:
    """doc_id, line_no, last_line, license, dice for each run of lines of ``docs`` (doc_id, text, ...) that matches a template.

    A run is one line, or lines of no more words than ``most_words`` of the template's, and begins with a line that
    holds one of its pairs, with the word after the line if need be. From each line on, the run with the largest coefficient
    counts, the shortest of equal ones; of runs that overlap, the one with the largest coefficient stays, ties to the smaller name, then to the
    earlier one. Lines are numbered from 0. Null, empty and wordless texts match nothing; repeated
    rows each give their rows; extra columns are ignored; an empty table gives no rows. A document is
    compared where it lies, without joins; a long text costs time in proportion to its lines, and no row a line.
    """
    known = sorted((name, template_pairs(text), len(template_words(text))) for name, text in (TEMPLATES if templates is None else templates).items())
    known = [(name, pairs, size) for name, pairs, size in known if pairs]
    wanted = sorted({w for _, pairs, _ in known for w in needles(pairs, least)})
    if not known:
        return docs.sparkSession.createDataFrame([], "doc_id long, line_no int, last_line int, license string, dice double")
    table = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.array(*map(F.lit, p)).alias("pairs"), F.lit(len(p)).alias("n"), F.lit(least_shared(len(p), least)).alias("need"),
            F.lit(most_pairs(len(p), least)).alias("most"), F.lit(most_words(size, least)).alias("words"),
        )
        for name, p, size in known
    ])
    some = docs.where(let(F.lower("text"), lambda low: reduce(operator.or_, [low.contains(w) for w in wanted])))
    every = F.array(*map(F.lit, sorted({p for _, pairs, _ in known for p in pairs})))
    few = F.array(*map(F.lit, wanted))
    # Only lines with words can add to a run: their number is kept beside them.
    numbered = F.transform(F.split("text", separator), lambda line, i: F.struct(i.alias("no"), words(line).alias("w")))
    lines = F.filter(numbered, lambda line: F.size(line["w"]) > 0)

    def compared(flat: Column) -> Column:
        """The templates that the words of a text can match; pairs are made only if one of the needles is a word."""
        hits = F.array_intersect(F.array_distinct(word_pairs(flat)), every)
        near = let(hits, lambda h: F.filter(table, lambda t: F.size(F.array_intersect(h, t["pairs"])) >= t["need"]))
        return F.when(F.arrays_overlap(flat, few), near)

    near = lambda x: let(F.flatten(F.transform(x, lambda line: line["w"])), compared)
    some = some.select("doc_id", F.explode(F.array(let(lines, lambda x: F.struct(x.alias("lines"), near(x).alias("near"))))).alias("m"))
    some = some.select("doc_id", F.col("m.lines").alias("lines"), F.col("m.near").alias("near")).where(F.size("near") > 0)
    rows = some.select("doc_id", "lines", F.explode("near").alias("t"))  # a row a document and template
    state = F.struct(
        F.array().cast("array<string>").alias("set"), F.array().cast("array<string>").alias("end"), F.lit(False).alias("done"), F.lit(0).alias("words"), F.lit(0.0).alias("dice"), F.lit(-1).alias("last")
    )

    def grow(s: Column, line: Column) -> Column:
        def judged(x: Column) -> Column:
            union, length = x["union"], x["length"]
            dice = 2.0 * F.size(F.array_intersect(union, F.col("t.pairs"))) / (F.size(union) + F.col("t.n"))
            better = (dice > s["dice"]) & ((s["words"] == 0) | (length <= F.col("t.words")))
            return F.struct(
                union.alias("set"), F.slice(line["w"], -1, 1).alias("end"), ((F.size(union) > F.col("t.most")) | (length >= F.col("t.words"))).alias("done"), length.alias("words"),
                F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, line["no"]).otherwise(s["last"]).alias("last"),
            )

        union = F.array_union(s["set"], word_pairs(F.concat(s["end"], line["w"])))
        return F.when(s["done"], s).otherwise(let(F.struct(union.alias("union"), (s["words"] + F.size(line["w"])).alias("length")), judged))

    def begins(line: Column, i: Column) -> Column:
        after = F.get("lines", i + 1)["w"]
        return F.arrays_overlap(word_pairs(F.when(after.isNotNull(), F.concat(line["w"], F.slice(after, 1, 1))).otherwise(line["w"])), F.col("t.pairs"))

    # A run takes a line with a word at least for each word it may have, so what is folded is bounded. Lines are
    # fetched by number: a slice would read all of a long text's lines for each start.
    onward = lambda i: F.sequence(i, F.least(i + F.col("t.words"), F.size("lines")) - 1)
    places = F.transform("lines", lambda line, i: F.when(begins(line, i), i))
    starts = F.filter(places, lambda i: i.isNotNull())
    best = F.transform(starts, lambda i: F.struct(F.get("lines", i)["no"].alias("no"), F.aggregate(onward(i), state, lambda s, k: grow(s, F.get("lines", k))).alias("b")))
    found = F.transform(
        F.filter(best, lambda x: x["b"]["dice"] >= least),
        lambda x: F.struct(x["no"].alias("line_no"), x["b"]["last"].alias("last_line"), F.col("t.license").alias("license"), x["b"]["dice"].alias("dice")),
    )
    windows = rows.select("doc_id", "lines", found.alias("found")).where(F.size("found") > 0)
    return _without_overlaps(windows)


def _without_overlaps(windows: DataFrame) -> DataFrame:
    """Of a document's overlapping windows the best; a document's rows meet by its lines, so repeated rows keep apart by their number."""
    key = [F.col("doc_id"), F.xxhash64("lines").alias("_a"), F.xxhash64(F.lit("lines"), "lines").alias("_b")]
    # Rows of one template of equal documents are equal: how often one comes is the number of copies.
    of_text = windows.select(*key, "found").groupBy("doc_id", "_a", "_b", "found").agg(F.count("*").alias("copies"))
    grouped = of_text.groupBy("doc_id", "_a", "_b", "copies").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("ws"))
    # From each line on a template has one window, so all that reach a window are among its nearest ones in order of line.
    span = F.array_max(F.transform("ws", lambda w: w["last_line"] - w["line_no"])) + 1
    kinds = F.size(F.array_distinct(F.transform("ws", lambda w: w["license"])))
    grouped = grouped.withColumn("reach", span * kinds)

    def beaten(w: Column, i: Column) -> Column:
        def beats(v: Column) -> Column:
            order = F.struct(-v["dice"], v["license"], v["line_no"], v["last_line"]) < F.struct(-w["dice"], w["license"], w["line_no"], w["last_line"])
            return (v["line_no"] <= w["last_line"]) & (w["line_no"] <= v["last_line"]) & order

        near = F.sequence(F.greatest(i - F.col("reach"), F.lit(0)), F.least(i + F.col("reach"), F.size("ws") - 1))
        return F.exists(near, lambda k: beats(F.get("ws", k)))

    marked = F.transform("ws", lambda w, i: F.struct(w.alias("w"), beaten(w, i).alias("beaten")))
    kept = grouped.select("doc_id", "copies", F.explode(F.filter(marked, lambda x: ~x["beaten"])).alias("x"))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "x.w.*")


def oracle(templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> str:
    """The same rows by all runs of lines of each document that as a whole shares enough pairs with a template."""
    quoted = {k: v.replace("'", "''") for k, v in (TEMPLATES if templates is None else templates).items()}
    values = ", ".join(f"('{k}', '{t}')" for k, t in quoted.items())
    ws = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    with t0 as (select license, {ws.format("notice")} as w from (values {values}) v(license, notice)), t as (select license, {pairs.format("w")} as tp, floor(len(w) * (2 - {least}::double) / {least}::double + 1e-9) as words from t0),
    d0 as (select doc_id, list_transform(string_split(text, chr(10)), lambda l: {ws.format("l")}) as lines from documents where text is not null),
    d1 as (select doc_id, lines, flatten(lines) as w from d0), d2 as (select doc_id, lines, {pairs.format("w")} as dp from d1),
    c as (select doc_id, lines, license, tp, words from d2, t where len(list_intersect(dp, tp)) >= ceil(len(tp) * {least}::double / (2 - {least}::double) - 1e-9)),
    s0 as (select *, unnest(range(0, len(lines))) as i from c), s1 as (select *, flatten(lines[i + 1:i + 1 + words::bigint])[1:len(lines[i + 1]) + 1] as fw from s0 where len(lines[i + 1]) > 0),
    n1 as (select *, case when len(fw) > len(lines[i + 1]) then fw else flatten(lines[i + 1:])[1:len(lines[i + 1]) + 1] end as nw from s1), s as (select * from n1 where len(list_intersect({pairs.format("nw")}, tp)) > 0),
    e as (select *, unnest(range(i, len(lines))) as j from s),
    x as (select doc_id, license, tp, words, i, j, flatten(lines[i + 1:j + 1]) as w from e), p as (select doc_id, license, tp, i, j, {pairs.format("w")} as wp from x where i = j or len(w) <= words),
    m as (select doc_id, license, i, j, 2.0::double * len(list_intersect(wp, tp)) / (len(wp) + len(tp)) as dice from p),
    b as (select * from m where dice >= {least} qualify row_number() over (partition by doc_id, license, i order by dice desc, j) = 1)
    select doc_id, cast(i as integer) as line_no, cast(j as integer) as last_line, license, dice from b
    where not exists (select 1 from b v where v.doc_id = b.doc_id and v.i <= b.j and b.i <= v.j and (-v.dice, v.license, v.i, v.j) < (-b.dice, b.license, b.i, b.j))
    """
