"""The parsers that run as kernels, by name. More can be registered; workers see those of modules that they import."""

from __future__ import annotations

import struct
from collections.abc import Callable

from framelake.operators import kernels, kernels_audio, kernels_container, kernels_image, kernels_mkv, kernels_mp4, kernels_tags, kernels_video
from framelake.operators.kernels import Found

Kernel = Callable[[bytes, Found], bool]

#: Kernels by the name of their parser.
KERNELS: dict[str, Kernel] = kernels.KERNELS | kernels_audio.KERNELS | kernels_image.KERNELS | kernels_video.KERNELS | kernels_container.KERNELS | kernels_mp4.KERNELS | kernels_mkv.KERNELS
#: These are Catalyst layouts where detection meets them; the kernels serve callers with bytes at hand.
IN_LAYOUTS = frozenset(("vp8",))


def parser(name: str) -> Callable[[Kernel], Kernel]:
    """Registers a kernel as the parser ``name``."""

    def register(kernel: Kernel) -> Kernel:
        KERNELS[name] = kernel
        return kernel

    return register


Row = tuple[int, int, str, str, bool]


def run_kernel(name: str, data: bytes) -> tuple[list[Row], bool] | None:
    """The fields (kind_id, pos, name, value, is_extra) of a blob by one parser, and whether it is cut off or damaged;
    None if the parser rejects it."""
    found = Found()
    try:
        if not KERNELS[name](data, found):
            return None
        kernels_tags.tags(name, data, found)
    except (IndexError, struct.error, ValueError, OverflowError, ZeroDivisionError):
        found.cut = True  # what was read before stands
        if not found.rows:
            return None
    return [(k, p, n, v, e) for (k, p, n, e), v in found.rows.items()], found.cut


def first_accepting(names: list[str], data: bytes) -> tuple[str, list[Row], bool] | None:
    """The first of some parsers that accepts a blob, with its fields and whether the blob is cut off."""
    for name in names:
        if (out := run_kernel(name, data)) is not None:
            return name, *out
    return None
