"""Licence texts as published, wrapped, unwrapped and in comments."""

import re
import textwrap

from tessera.llm import licenses

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = f"""MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{AS_IS}"""
BSD2 = """Copyright (c) 2020, A. Person. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
NAME = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
LIABLE = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
TEXTS = [
    (MIT, "MIT"), (BSD2 + LIABLE, "BSD-2-Clause"), (f"{BSD2}\n3. {NAME.format('the copyright holder')}\n{LIABLE}", "BSD-3-Clause"),
    (f"{BSD2}\n3. {NAME.format('Example University')}\n{LIABLE}", "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (GPL.replace("software: ", "software; ").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0-or-later"),
    (f"GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nHow to Apply These Terms to Your New Programs\n\n{GPL}", "GPL-3.0"), (APACHE, "Apache-2.0"),
    ("This code is released under the MIT License", "MIT"), ("Licensed under CC BY 4.0\nand more text", "CC-BY-4.0"), ("All rights reserved.", "proprietary"), ("Prose on software versions.", ""),
]


def wrapped(text, width, mark=""):
    return "\n\n".join(textwrap.fill(p, width, initial_indent=mark, subsequent_indent=mark) for p in re.split(r"\n\n+", text))


def test_texts_are_found_however_they_are_wrapped(spark):
    forms = [lambda t: t, lambda t: wrapped(t, 72), lambda t: wrapped(t, 40, "# "), lambda t: wrapped(t, 60, " * "), lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split())]
    rows = [(100 * i + k, f(t), want) for i, (t, want) in enumerate(TEXTS) for k, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert [(i, got[i]) for i, _, _ in rows] == [(i, want) for i, _, want in rows]


def test_known_sentences_pass_the_first_filter():
    assert all(re.search(licenses.SOME, s) and re.fullmatch("[a-z0-9 ]+", s) for s in licenses.SENTENCES)
    assert {x for _, ids in licenses.RULES for x in ids} == set(licenses.SENTENCES.values())


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MORE = [
    (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (ISC, "ISC"), (ISC.split(", provided")[0] + ".", "0BSD"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("CC0 1.0 Universal", "CC0-1.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "CC-BY-NC-ND-4.0"), ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"),
    (None, ""), ("", ""), ("the library is nice", ""),
]


def sequences(text):
    """The scan by plain Python: known sentences in order, then rules on what is left of their chain."""
    plain = " " + re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip() + " "
    found, at = [], 0
    while at < len(plain):
        here = max((s for s in licenses.SENTENCES if plain.startswith(f" {s} ", at)), key=len, default=None)
        if here:
            found.append(licenses.SENTENCES[here])
        at = plain.index(" ", at + 1 + len(here or "")) if plain.find(" ", at + 1 + len(here or "")) >= 0 else len(plain)
    chain, names = ">" + ">".join(found) + ">", []
    for name, ids in licenses.RULES:
        if (part := ">" + ">".join(ids) + ">") in chain:
            names.append(name)
            chain = chain.replace(part, ">>")
    names = list(dict.fromkeys(names))
    names = [n for n in names if n != "proprietary"] if len(names) > 1 else names
    return ",".join(found), ",".join(names), len(found)


def test_more_licences_and_brute_force(spark):
    texts = [t for t, _ in MORE] + [MIT, BSD2, f"{LGPL} {ISC} all rights reserved", f"# {AGPL}\n# {MIT}"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, licenses string")
    got = licenses.scan(rows).collect()
    assert len(got) == 2 * len(texts) and licenses.scan(rows.limit(0)).count() == 0
    for r in got:
        assert (r.sentence_ids, r.licenses, r.n_sentences) == sequences(texts[r.doc_id]), texts[r.doc_id]
    for i, (_, name) in enumerate(MORE):
        assert {r.licenses for r in got if r.doc_id == i} == {name}
