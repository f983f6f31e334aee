"""License statements over several lines, and words that stand too far apart."""

from palisade.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
ISC = "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
GPL = "GNU General Public License\nversion 3"


def test_wrapped_and_far(spark):
    far = " word ".join(["released"] + ["x"] * 40 + ["under"] + ["x"] * 40 + ["the"] + ["x"] * 40 + ["mit"] + ["x"] * 40 + ["license"])
    texts = [MIT, BSD, ISC, MPL, GPL, far, f"{far} released under the mit license {far}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "isc", 3: "mpl-2.0", 4: "gpl,gpl-3.0", 5: "", 6: "mit"}
