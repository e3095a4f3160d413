"""Builds small PDF files for tests."""

import zlib


def build(bodies: list, root: int, trailer: str = "") -> bytes:
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += f"{i} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    return bytes(out + f"trailer\n<< /Size {len(bodies) + 1} /Root {root} 0 R {trailer} >>\nstartxref\n{start}\n%%EOF".encode())


def stream(data: bytes, extra: str = "", flate: bool = False) -> bytes:
    data = zlib.compress(data) if flate else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if flate else ''} {extra} >>\nstream\n".encode() + data + b"\nendstream"


def one_page(content: bytes, page: str = "", more: tuple = (), catalog: str = "", trailer: str = "", flate: bool = False, box: str = "0 0 200 200") -> bytes:
    """Objects: 1 catalog, 2 pages, 3 page, 4 content, 5 font, then more."""
    bodies = [
        f"<< /Type /Catalog /Pages 2 0 R {catalog} >>", f"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [{box}] >>", f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> {page} >>",
        stream(content, flate=flate), "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", *more,
    ]
    return build(bodies, 1, trailer)
