"""Licence texts as they stand in source files: wrapped, and behind comment marks."""

import pytest

from samples import make_docs
from voltrail.llm.licenses import scan_licenses

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0
(the "License");
you may not use this file except in compliance
with the License.
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
TEXTS = [("MIT", MIT, 3), ("BSD-2-Clause", BSD, 3), ("Apache-2.0", APACHE, 3), ("GPL-3.0-or-later", GPL, 2)]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_texts(spark, mark):
    rows = [(n, "\n".join(mark + line for line in text.split("\n"))) for n, (_, text, _) in enumerate(TEXTS)]
    found = {r["doc_id"]: r for r in scan_licenses(make_docs(spark, rows)).collect()}
    for n, (licence, _, known) in enumerate(TEXTS):
        assert (found[n]["licenses"], found[n]["n_known"]) == (licence, known), found[n]


def test_cue_in_any_spelling(spark):
    rows = list(enumerate(["All rights reserved", "All rights\u00a0reserved", "ALL-RIGHTS-RESERVED", "all rights"]))
    found = {r["doc_id"]: r["licenses"] for r in scan_licenses(make_docs(spark, rows)).collect()}
    assert found == {0: "all-rights-reserved", 1: "all-rights-reserved", 2: "all-rights-reserved", 3: ""}


def test_blank_lines_and_full_stops_end_sentences(spark):
    rows = [(0, "licensed under the\n\nMIT license"), (1, "licensed under the.\nMIT license"), (2, "licensed under the\nMIT license")]
    found = {r["doc_id"]: (r["licenses"], r["first_at"]) for r in scan_licenses(make_docs(spark, rows)).collect()}
    assert found == {0: ("", None), 1: ("", None), 2: ("MIT", 0)}
