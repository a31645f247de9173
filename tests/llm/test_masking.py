"""Private keys are masked with their bodies."""

import base64
import random

from keystrata.llm import secrets

HEAD, TAIL = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def body(size, width=64, end="\n"):
    line = base64.b64encode(random.Random(size).randbytes(size)).decode()
    return end.join(line[i : i + width] for i in range(0, len(line), width))


def test_private_keys_are_masked_whole(spark):
    key, long = body(1190), body(1_000_000)
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n"
    want = {
        f"a\n{HEAD}\n{key}\n{TAIL}\nb": "a\n[secret]\nb",
        f"a\n{HEAD}\n{head}{key}\n{TAIL}\nb": "a\n[secret]\nb",
        f"a\n{HEAD}\n{key}\nThe prose goes on.": "a\n[secret]\nThe prose goes on.",
        f"a\n{HEAD}\n{head}{key}\nThe prose goes on.": "a\n[secret]\nThe prose goes on.",
        f"a {HEAD} {body(96, end=' ')} {TAIL} b": "a [secret] b",
        f'"{HEAD}\\n{body(96, end=chr(92) + "n")}\\n"': '"[secret]\\n"',
        f"{HEAD}\n{body(80)}\n{HEAD}\n{key}\n{TAIL} b": "[secret]\n[secret] b",
        f"a {HEAD} is how keys begin.": "a [secret] is how keys begin.",
        f"{HEAD}\n{long}\n{TAIL}": "[secret]",
        f"{HEAD}\n{long}": "[secret]",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
