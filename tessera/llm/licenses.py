"""Operator 2, licence scans by sentence rules.

A text is normalised: lower case, letters and digits only, words joined by one space, so that line ends and comment marks
within a sentence don't matter. Known licence sentences, wherever they stand in it as whole words, have identifiers; the identifiers of a text, in order, make one string, and each
rule is an ordered sequence of identifiers that must follow one another in it (other known sentences may not stand
between them, unknown ones may). Rules are tried in order; one whose identifiers all belong to an earlier match of a longer rule is left out.
Rights reserved make a text proprietary only if it has no licence, as the BSD texts reserve them too.

Null and empty texts have no licence. Every row is judged alone, so ties and repeated rows are alike; a table without rows gives none.
A long text is normalised and searched as one row, in time in proportion to its length. Other columns are ignored, whatever
their names. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

# Licence sentences, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "available under the mit license": "mit-notice",
    "under the terms of the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "apache license version 2 0 january 2004": "apache-text",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license version 3 29 june 2007": "gpl3-text",
    "gnu general public license version 2 june 1991": "gpl2-text",
    "how to apply these terms to your new programs": "gpl-apply",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-v3-later",
    "either version 2 of the license or at your option any later version": "gpl-v2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl-v3-only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-v3-only",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl-v2-only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-v2-only",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-text",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-text",
    "gnu library general public license version 2 june 1991": "lgpl2-text",
    "gnu affero general public license version 3 19 november 2007": "agpl3-text",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "either version 2 1 of the license or at your option any later version": "gpl-v21-later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-text",
    "cc0 1 0 universal": "cc0-text",
    "creative commons zero v1 0 universal": "cc0-text",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib-grant",
    "boost software license version 1 0": "bsl-text",
    "eclipse public license v 2 0": "epl-text",
    "eclipse public license version 2 0": "epl-text",
    "creative commons attribution noderivatives 4 0 international": "cc-by-nd-notice",
    "creative commons attribution noncommercial sharealike 4 0 international": "cc-by-nc-sa-notice",
    "creative commons attribution noncommercial noderivatives 4 0 international": "cc-by-nc-nd-notice",
    "creative commons attribution 4 0 international": "cc-by-notice",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa-notice",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-ads",
    "mozilla public license version 2 0": "mpl-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "all rights reserved": "reserved",
}
# Rules in order, longer sequences of a licence first.
RULES = [
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-text"]),
    ("GPL-3.0", ["gpl-apply", "gpl-free", "gpl-terms", "gpl-v3-later"]),
    ("GPL-2.0", ["gpl-apply", "gpl-free", "gpl-terms", "gpl-v2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "gpl-v21-later"]),
    ("LGPL-2.0-or-later", ["lgpl-free", "lgpl-terms", "gpl-v2-later"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl-terms", "gpl-v3-later"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl-terms", "gpl-v21-later"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl-terms", "gpl-v3-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-terms", "gpl-v3-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl-v3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl-v2-later"]),
    ("GPL-3.0", ["gpl-free", "gpl-v3-only"]),
    ("GPL-2.0", ["gpl-free", "gpl-v2-only"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("LGPL-3.0", ["lgpl3-text"]),
    ("LGPL-2.1", ["lgpl21-text"]),
    ("LGPL-2.0", ["lgpl2-text"]),
    ("AGPL-3.0", ["agpl3-text"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["bsd0-grant"]),
    ("Unlicense", ["unlicense-text"]),
    ("CC0-1.0", ["cc0-text"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSL-1.0", ["bsl-text"]),
    ("EPL-2.0", ["epl-text"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-notice"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-ads", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("MPL-2.0", ["mpl-text"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("proprietary", ["reserved"]),
]
# every known sentence has one of these
SOME = r"(?i)licen[sc]e|permi|redistrib|software|rights|version|commons|programs|cc0"


def identifiers(text: str) -> Column:
    """Identifiers of the known sentences, in order; of two that start at one place, the longer one's."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    each = "|".join(sorted(SENTENCES, key=len, reverse=True))
    found = F.when(F.col(text).rlike(SOME), F.regexp_extract_all(plain, F.lit(f"(?<![a-z0-9])({each})(?![a-z0-9])"), F.lit(1)))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.try_element_at(known, s))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses (in order of the rules, each once) and n_sentences (known ones)."""
    rows = docs.select("doc_id", identifiers("text").alias("sentence_ids"))
    chain = F.concat(F.lit(">"), F.concat_ws(">", "sentence_ids"), F.lit(">"))
    rows = rows.withColumn("_rest", chain)
    names = []
    for name, ids in RULES:  # a matched sequence is used up, so a shorter rule doesn't match within it
        sequence = F.lit(">" + ">".join(ids) + ">")
        names.append(F.when(F.col("_rest").contains(sequence), F.lit(name)))
        rows = rows.withColumn(f"_r{len(names)}", names[-1]).withColumn("_rest", F.replace("_rest", sequence, F.lit(">>")))
    own = F.array_distinct(F.array_compact(F.array(*[F.col(f"_r{i + 1}") for i in range(len(RULES))])))
    found = F.when(F.size(own) > 1, F.array_remove(own, "proprietary")).otherwise(own)
    return rows.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", found).alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
