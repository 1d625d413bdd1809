"""Small images and archives for tests."""

import io
import json
import struct
import tarfile

import numpy as np


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def write_tar(path, files):
    with tarfile.open(path, "w") as tar:
        for name, payload in files:
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
    return str(path)


def latent_tar(path, count, alone=False):
    files = []
    for i in range(count):
        b = io.BytesIO()
        np.save(b, np.full((2, 2, 2), i, np.float16))
        files += [(f"s{i}.latent.npy", b.getvalue()), (f"s{i}.json", json.dumps({"i": i}).encode())]
    return write_tar(path, files[:-1] if alone else files)
