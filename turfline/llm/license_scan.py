"""Licence scan by canonical digests: DataFrame functions only.

A text is brought to a canonical form (case folded, copyright lines removed, equivalent spellings unified,
punctuation and white space reduced to single spaces), its SHA-256 is joined to the digests of known licence
texts and notices. Whole texts are looked up, and so is every line of every text, since notices stand on lines
of their own.

Null texts count as empty. Texts whose canonical form is empty match nothing. Very long texts and lines are brought to
canonical form whole. Ties: of several licences with one digest the least identifier is named. Repeated rows give
repeated results. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

# Licence texts and notices in public use, by SPDX identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Proprietary", "All rights reserved."),
)

# The sentences of the BSD licences, their titles and the names that copies put into them.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_DISCLAIMER = (
    'This software is provided by {all} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. '
    "In no event shall {any} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
    "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
BSD_TITLES = {2: ("", "BSD 2-Clause License", "The BSD 2-Clause License"), 3: ("", "BSD 3-Clause License", "The BSD 3-Clause License")}
BSD_NAMES = ("the copyright holder", "the University")
BSD_PARTIES = ("copyright holder", "copyright holders", "regents", "author")
BSD_MARKS = (("1.", "2.", "3."), ("", "", ""), ("a.", "b.", "c."))


def bsd_texts() -> list[tuple[str, str]]:
    """Every BSD text of two or three clauses that these titles, marks and names make."""
    out = []
    for n, titles in BSD_TITLES.items():
        for title, rights, marks, name, party in product(titles, ("", "All rights reserved."), BSD_MARKS, BSD_NAMES if n == 3 else ("",), BSD_PARTIES):
            either = "copyright holder" if party == "copyright holders" else party
            clauses = [f"{m} {c.format(name=name)}" for m, c in zip(marks, BSD_CLAUSES[:n], strict=False)]
            tail = BSD_DISCLAIMER.format(all=f"the {party} and contributors", any=f"the {either} or contributors")
            out.append((f"BSD-{n}-Clause", "\n".join([title, rights, BSD_HEAD, *clauses, tail])))
    return out


# SPDX identifier, digest and length of the canonical form of whole licence texts, with and without title,
# "All rights reserved", appendix and clause numbers where copies differ in these. KNOWN alone is what the SQL holds.
WHOLE = (
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7", 501),
    ("Apache-2.0", "c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073", 502),
    ("Apache-2.0", "943bb73999aec94aa4b2f7a2278dcda1de8c61c618fce9e0d6aaef0344d2b5ec", 8714),
    ("Apache-2.0", "9bd3d346fde9891f52e7dc4b8d8936c9e446536fd5eade45a50e39034a5530b4", 8742),
    ("Apache-2.0", "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549", 8773),
    ("Apache-2.0", "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9", 8801),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f", 8842),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809", 8843),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40", 8870),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93", 8871),
    ("Apache-2.0", "673437f154fdc34e7f3a960def9c0fc712d4aa55dd739bebb2b1644193bb51a6", 9798),
    ("Apache-2.0", "8306cd454134a970ab94f01b254e20e8371c9b782cc3059aceae2925d76fcc73", 9799),
    ("Apache-2.0", "deb545743ba2ee484c58a92230d43f8b6a39185ee86d9256ffdfefdb82b1dc6d", 9857),
    ("Apache-2.0", "958d96a93165bf855e5c8741b148490ae2dc4ebd5b44614c4ab58cafd65c8eec", 9858),
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25", 9926),
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f", 9928),
    ("CC0-1.0", "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e", 6645),
    ("CC0-1.0", "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a", 6663),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", 6691),
    ("GPL-2.0-only", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1", 14408),
    ("GPL-2.0-only", "639c69262acf6777ee0c163867caf39bdb5ec90b59bad9412c9e6101fb65e404", 14428),
    ("GPL-2.0-only", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2", 14436),
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", 14455),
    ("GPL-2.0-only", "b519669ce969d79c162f16dca67a0abab53b46986efb528afe3e105936cc0050", 14456),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483),
    ("GPL-2.0-only", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3", 17070),
    ("GPL-2.0-only", "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f", 17090),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-3.0-only", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2", 30890),
    ("GPL-3.0-only", "888dd3b6e21b31412e3e47000b49d18dbd8f52fb42ccb5fc3108c8ca3c150b16", 30913),
    ("GPL-3.0-only", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19", 30918),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", 30940),
    ("GPL-3.0-only", "7649ebbf3b070f38d710d6c6b656cbe1d02e00991423dedb73cb040e73d42572", 30941),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968),
    ("GPL-3.0-only", "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3", 33356),
    ("GPL-3.0-only", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64", 33359),
    ("GPL-3.0-only", "bf9e206799496404ec781ceaf777966308e875445239b2a25248b6a0f817844d", 33379),
    ("GPL-3.0-only", "25c090443e3540e3493172ea88c9181108effea290e12e68da7dcd1c51b4cd7a", 33382),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", 33409),
    ("ISC", "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29", 676),
    ("ISC", "673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317", 688),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee", 691),
    ("ISC", "8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc", 692),
    ("ISC", "8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f", 692),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1", 695),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db", 695),
    ("ISC", "a285b2987fbd98096b971c73f42998e424fd3014a9690457259734f639dee8eb", 696),
    ("ISC", "f9324348da82c2d9b4a0b0b8229973a6806c67a5b5628e587181e15e03c66d69", 696),
    ("ISC", "5456fff23cf44064ff54d9d973cf8a7204e2788759d3d01ba3de38afc4515eee", 699),
    ("ISC", "71e638daa9a9b5572892642ad3b2898d7860124998d2bff139e1f88d7dd38679", 699),
    ("ISC", "bb7a7962f5774a5aa102d77fce97308caa6bead07a624c64b3c0e7e48f6a4bad", 708),
    ("ISC", "fd4e450e334b5e7722a9cb4a5ef92dda5eeb172eeee17b631a720d12591461b1", 711),
    ("ISC", "1ed7296301d616a11b9a1e23a9f15ed4195117107d1aa7e1b411c2682d11fb98", 712),
    ("ISC", "a6384b33afd7f77584664a3a36644717281a88522df1f957bee8eef971453563", 712),
    ("ISC", "80c91bc2efd3e78116e00fde9052e737ea04907e8766e36081f7f7c856edfa95", 715),
    ("ISC", "86cadf6b8ff9a33f9f1268672376624474ebcae80a1a08747115581a22146101", 715),
    ("ISC", "3dc12d73102aba64473db007f9d57547ad2bf6ec87d530ae8b8d93b316648003", 716),
    ("ISC", "83381f2ba91f8b4b5a524e928f0229510a7656a35772582d1c5e0f3ac5112220", 719),
    ("LGPL-2.1-only", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd", 23277),
    ("LGPL-2.1-only", "02d1c6765d5d7d83c080934e4f4d4e8a534db157a3addff8d581f70e285a297a", 23303),
    ("LGPL-2.1-only", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4", 23305),
    ("LGPL-2.1-only", "1b0f2373f80527d4e0de3c4558c0b3804f46c844770e82398a9876c782f360f9", 23331),
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", 23337),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365),
    ("LGPL-2.1-only", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f", 25157),
    ("LGPL-2.1-only", "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4", 25183),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-3.0-only", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7", 7047),
    ("LGPL-3.0-only", "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765", 7070),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164", 1000),
    ("MIT", "f6977bef8312da49f220a7043e358dc5a0eabeb03043faa779ca620a540879bd", 1000),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f", 1004),
    ("MIT", "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4", 1004),
    ("MIT", "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9", 1008),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127", 1008),
    ("MIT", "16a82fdd59be9a9d0a1867aa97f08f5a87049f25bcfc39fe9c20eed00f5dcb80", 1020),
    ("MIT", "fb691d28b64b2a306b30449f04b63780c13263eccc568cc65d7f25fe9748dba2", 1020),
    ("MIT", "95d6e15f26b09973979cc939f067e143dab922c3ae8273ea44b568d429da0660", 1024),
    ("MIT", "9803b59d0b48bc4c33519eaf3d6e133d08c752f8f17a5cd3d6198abdf08e49c4", 1024),
    ("MIT", "8cde46b543036122641d289a848d3900df55f9efa471b2ff7354da3a6e4a113d", 1028),
    ("MPL-2.0", "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3", 13626),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de", 13661),
    ("MPL-2.0", "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979", 14307),
    ("MPL-2.0", "f29410a4b9cf7ada059b5029550f39fe3cbfc5504fdab2a0b727735754430394", 14308),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", 14342),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6", 14343),
)

# Spellings that are read as one, in the order in which they are replaced.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

#: Java and RE2 read these alike. A copyright line names a year or the sign after the word.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    text = F.regexp_replace(text, NOT_WORD, " ")
    for old, new in EQUIVALENT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(text)


def canonical_sql(text: str) -> str:
    """The same in DuckDB."""
    out = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', ' ', 'g')"
    for old, new in EQUIVALENT:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out}, ' ')"


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """canonical digest, licence id and length of the canonical form; as long as the list above."""
    rows = spark.createDataFrame([(a, b) for a, b in known], "license_id string, body string")
    form = canonical(F.col("body"))
    rows = rows.select("license_id", F.sha2(form.cast("binary"), 256).alias("known_digest"), F.length(form).alias("n"))
    return rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"), F.first("n").alias("n"))


def scan(docs: DataFrame, known=KNOWN, whole=WHOLE, made=bsd_texts) -> DataFrame:
    """doc_id, canonical_sha256, license_id of the whole text (or null), line_licenses (sorted ids, comma-joined), n_license_lines."""
    spark = docs.sparkSession
    table = known_digests(spark, [*known, *made()]).collect()  # a fixed list, not data
    ids = {d: i for i, d, _ in whole} | {r["known_digest"]: r["license_id"] for r in table}
    sizes = sorted({r["n"] for r in table} | {n for *_, n in whole})
    known_rows = F.broadcast(spark.createDataFrame(list(ids.items()), "known_digest string, license_id string"))
    by_digest = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    # only a canonical form of a known length is hashed and looked up
    named = lambda form: F.when(F.length(form).isin(sizes), F.try_element_at(by_digest, F.sha2(form.cast("binary"), 256)))
    forms = F.transform(F.split(whole_text(), "\n"), canonical)
    lines = F.filter(F.transform(forms, named), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.sha2(canonical(whole_text()).cast("binary"), 256).alias("canonical_sha256"), lines.alias("lines"))
    rows = rows.join(known_rows, F.col("canonical_sha256") == F.col("known_digest"), "left")
    return rows.select(
        "doc_id",
        "canonical_sha256",
        "license_id",
        F.array_join(F.array_sort(F.array_distinct("lines")), ",").alias("line_licenses"),
        F.size("lines").cast("long").alias("n_license_lines"),
    )
