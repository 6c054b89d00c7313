"""A copy of a SentencePiece model, in memory, that the library treats as a unigram model over the same pieces."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, wire type, start of the field, start and end of its value)."""
    at = 0
    while at < len(data):
        begin = at
        key, at = _varint(data, at)
        kind, start = key & 7, at
        if kind == 0:
            _, at = _varint(data, at)
        elif kind == 2:
            n, start = _varint(data, at)
            at = start + n
        else:
            at += 4 if kind == 5 else 8
        yield key >> 3, kind, begin, start, at


def as_unigram(data: bytes) -> bytes:
    for number, _, _, start, end in _fields(data):
        if number == 2:  # the trainer's settings; their field 3 is the kind of model, 1 for unigram
            for inner, _, _, a, _ in _fields(data[start:end]):
                if inner == 3:
                    return data[: start + a] + b"\x01" + data[start + a + 1 :]
    raise ValueError("no kind of model in this file")
