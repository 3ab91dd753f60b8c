"""Public notices as they stand in files, and what only looks like them."""

import pytest

from bizmetrics.llm import licenses

NOTICES = {
    "lgpl-2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public\n * License as published by the Free Software Foundation; either version 2.1 of the License",
    "lgpl-3": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "agpl-3": "under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, "
    "either version 3 of the License",
    "gpl-3": "under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License",
    "bsd-3": "Neither the name of the <ORGANIZATION> nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
    "and accompanying documentation covered by this license (the \"Software\")",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions:",
}
OTHERS = [
    "Under the terms of the contract as published by the free press, either version 3 of the licence or none.",
    "This work is described under creative headings; commons and attribution are discussed in 4.0 pages.",
    "Permission is granted to anyone to read this software manual for any purpose.",
]


@pytest.fixture(scope="module")
def labels(spark):
    texts = [*NOTICES.values(), *OTHERS]
    rows = [(i, f"some words before {t} and some behind") for i, t in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: r.labels for r in found}


def test_each_notice_has_its_label_alone(labels):
    assert [labels[i] for i in range(len(NOTICES))] == list(NOTICES)


def test_other_texts_have_none(labels):
    assert [labels[i + len(NOTICES)] for i in range(len(OTHERS))] == [""] * len(OTHERS)
