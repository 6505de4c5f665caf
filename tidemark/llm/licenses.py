"""Licence scans by sentence rules: sentences become identifiers, and ordered sequences of these name the licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: Known licence sentences, normalised (lower case, runs of other than letters and digits as one space).
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-5": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-title": "the mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "gpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-3": "see the gnu general public license for more details",
    "gpl-4": "you should have received a copy of the gnu general public license along with this program",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-1": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-1": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-1": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "reserved": "all rights reserved",
}
#: Rules: a licence and the sentences that state it, in this order. Longer rules of a licence stand before shorter ones.
RULES = (
    ("apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4", "apache-5")),
    ("apache-2.0", ("apache-1", "apache-2")),
    ("apache-2.0", ("apache-short",)),
    ("mit", ("mit-1", "mit-2", "mit-3")),
    ("mit", ("mit-1", "mit-2")),
    ("mit", ("mit-title", "mit-1")),
    ("mit", ("mit-short",)),
    ("bsd-3-clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("bsd-2-clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("gpl-3.0-or-later", ("gpl-1", "gpl-2", "gpl-3")),
    ("gpl-3.0-or-later", ("gpl-1",)),
    ("gpl-3.0", ("gpl-short",)),
    ("cc-by-nc-4.0", ("cc-by-nc-short",)),
    ("cc-by-nc-4.0", ("cc-by-nc-1",)),
    ("cc-by-4.0", ("cc-by-short",)),
    ("cc-by-4.0", ("cc-by-1",)),
    ("cc-by-sa-4.0", ("cc-by-sa-short",)),
    ("cc-by-sa-4.0", ("cc-by-sa-1",)),
    ("all-rights-reserved", ("reserved",)),
)
#: Other sentences that may stand between two of a rule.
GAP = 2


def broken_text(text: Column) -> Column:
    """Normalised text between breaks, one mark for each run of them and one at either end.

    ``\\x01`` stands after . ! ? and ``\\x03`` after : and ; (each before white space) or for blank lines, ``\\x02`` for a
    single line end. Comment marks go with all else that is neither letter nor digit.
    """
    marked = F.regexp_replace(F.translate(text, "\x02\x03", "  "), r"[.!?](?=\s|$)", "\x01")
    marked = F.regexp_replace(F.regexp_replace(marked, r"[:;](?=\s|$)", "\x03"), r"\r?\n|\r", "\x02")
    plain = F.regexp_replace(F.concat(F.lit("\x01"), F.lower(marked), F.lit("\x01")), "[^\\p{L}\\p{N}\x01\x02\x03]+", " ")
    # runs of breaks are looked at from their first character only, so long ones cost no more than their length
    plain = F.regexp_replace(plain, "(?<![ \x01\x02\x03])[ \x02\x03]*+\x01[ \x01\x02\x03]*+", "\x01")
    plain = F.regexp_replace(plain, "(?<![ \x01\x02\x03])[ \x02]*+\x03[ \x02\x03]*+", "\x03")
    plain = F.regexp_replace(plain, "(?<![ \x01\x02\x03]) ?\x02 ?\x02[ \x02]*+", "\x03")
    return F.regexp_replace(plain, " ?\x02 ?", "\x02")


def scan_licenses(docs: DataFrame, *, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = GAP) -> DataFrame:
    """Per row ``doc_id, n_sentences, sentence_ids, licenses``.

    ``n_sentences`` counts what stands between breaks: line ends, and . ! ? : ; before white space; empty ones do not
    count. A known sentence is found wherever it stands from one break to another; line ends, blank lines, : and ;
    inside it read as spaces, so a wrapped notice counts like one on a line. ``sentence_ids`` are the known sentences of
    the text in order; ``licenses`` the sorted licences of all rules whose sentences follow one another in it, with at
    most ``gap`` other sentences between two, wrapped ones counting once; a sentence that occurs again begins anew. A
    rule counts beside a longer one of the same licence only once. Null and empty texts have no sentence and no licence;
    rows that repeat are scanned each; an empty table gives no rows; other columns are left out. The tables of sentences
    and rules are parameters of fixed size and live in the plan.
    """
    breaks = "[\x01\x02\x03]"
    known = F.create_map(*[F.lit(v) for name, line in sentences.items() for v in (line, name)])
    longest_first = sorted(sentences.values(), key=len, reverse=True)
    any_known = "|".join("[ \x02\x03]".join(re.escape(w) for w in line.split(" ")) for line in longest_first)
    # each place where a known sentence begins gets the longest one put before it
    tagged = F.regexp_replace("text", f"(?<={breaks})(?=({any_known}){breaks})", "\x04$1\x05")

    def found(part: Column) -> Column:
        """The known sentences that begin here, shorter ones first, and the other sentences before the next."""
        raw = F.substring_index(part, "\x05", 1)
        line = F.translate(raw, "\x02\x03", "  ")
        shorter = [F.when((line == long) & F.substring(raw, len(short) + 1, 1).isin("\x02", "\x03"), F.lit(name))
                   for name, short in sorted(sentences.items(), key=lambda s: len(s[1])) for long in sentences.values() if long.startswith(f"{short} ")]
        rest = part.substr(2 * F.length(raw) + 3, F.length(part))
        others = F.regexp_count(rest, F.lit("[\x01\x03]")) + F.endswith(rest, F.lit("\x02")).cast("int")
        return F.struct(F.array_compact(F.array(*shorter, known[line])).alias("ids"), others.alias("others"))

    rows = docs.select("doc_id", broken_text(text_of()).alias("text"))
    rows = rows.select("doc_id", (F.regexp_count("text", F.lit(breaks)) - 1).cast("long").alias("n_sentences"), F.split(tagged, "\x04").alias("parts"))
    rows = rows.withColumn("hits", F.transform(F.slice("parts", 2, F.size("parts")), found))
    chain = F.array_join(F.transform("hits", lambda h: F.concat(
        F.array_join(F.transform(h["ids"], lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""), F.when(h["others"] > gap, "!").otherwise(""))), "")
    named = F.array(*[F.when(chain.contains("".join(f"<{i}>" for i in ids)), F.lit(name)) for name, ids in rules])
    return rows.select("doc_id", "n_sentences", F.flatten(F.transform("hits", lambda h: h["ids"])).alias("sentence_ids"),
                       F.array_sort(F.array_distinct(F.array_compact(named))).alias("licenses"))
