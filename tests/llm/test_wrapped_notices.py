"""Notices whose lines are wrapped as they are usually published."""

from spectraloom.llm import licenses

NOTICES = {
    "mit-notice": "MIT\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.",
    "gpl,gpl-notice": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation.",
    "bsd-notice": "All rights reserved.\r\n\r\nRedistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:\r\n",
    "mpl-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this",
}


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scanned(docs).orderBy("doc_id").collect()]


def test_wrapped_notices(spark):
    assert labels(spark, NOTICES.values()) == list(NOTICES)


def test_scattered_words_and_paragraphs_do_not_meet(spark):
    words = NOTICES["bsd-notice"].split("\r\n\r\n")[1].split()
    scattered = "\n".join(f"{w} lantern canal river stone" for w in words)
    apart = "redistribution and use in source and binary forms with or without\n *\nmodification are permitted provided that the following conditions are met"
    assert labels(spark, [scattered, apart, None]) == ["", "", ""]
