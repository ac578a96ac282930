"""What a Python worker remembers, one operator at a time.

Spark uses a worker for many stages, so what one operator remembers would stay beside the next one's. An operator that
begins in a worker claims it: the others' memories are dropped, and freed memory goes back to the system. Spark may also
leave a worker unused while others, or the executor itself, need the memory; so an operator that is done with its rows says
so, and what it remembers is dropped unless its next task begins within ``IDLE_S`` seconds.
"""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

#: Seconds that an unused worker keeps what it remembers.
IDLE_S = 5.0

_clear: dict[str, Callable[[], None]] = {}
_owner: str | None = None
_lock = threading.RLock()
_busy = 0
_timer: threading.Timer | None = None


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Make ``owner`` the worker's operator; ``clear`` drops what it remembers, once another one claims the worker."""
    global _owner
    with _lock:
        if clear is not None:
            _clear[owner] = clear
        if owner == _owner:
            return
        for name in [n for n in _clear if n != owner]:
            _clear.pop(name)()
        _owner = owner
        _give_back()


@contextmanager
def task(owner: str, clear: Callable[[], None] | None = None) -> Iterator[None]:
    """Claim the worker for a task; without another one soon after its end, the worker's memories are dropped."""
    global _busy, _timer
    with _lock:
        _busy += 1
        if _timer is not None:
            _timer.cancel()
            _timer = None
    try:
        claim(owner, clear)
        yield
    finally:
        _trim()
        with _lock:
            _busy -= 1
            if not _busy:
                _timer = threading.Timer(IDLE_S, _drop)
                _timer.daemon = True
                _timer.start()


def _drop() -> None:
    global _owner
    with _lock:
        if _busy or threading.current_thread() is not _timer:  # a task has begun since
            return
        while _clear:
            _clear.popitem()[1]()
        _owner = None
        _give_back()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving the memory that it has freed back to the system when its task ends.

    For operators that remember nothing between tasks: else each unused worker holds what its largest task took.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def _give_back() -> None:
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its memory stays with the worker
        pass
