"""Bounded work ahead of a reader: files in flight, and items decoded before they are asked for."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar

X = TypeVar("X")
Y = TypeVar("Y")


def in_flight(items: Iterable[X], action: Callable[[X], Y], most: int, used: Callable[[Y], None] | None = None) -> Iterator[Y]:
    """``action`` of each item in order, at most ``most`` of them begun before they are asked for.

    ``used`` is called with a result when the next one is asked for, or when the reader stops. The
    next action begins only then, so results that still take room are ``most`` at any time. An error
    is raised in its turn; what was begun behind it is finished, and used up too.
    """
    if most < 1:
        raise ValueError("most must be positive")
    source, open_ = iter(items), list[Future]()
    with ThreadPoolExecutor(most) as pool:

        def begin() -> None:
            for x in source:
                open_.append(pool.submit(action, x))
                return

        try:
            for _ in range(most):
                begin()
            while open_:
                result = open_.pop(0).result()
                try:
                    yield result
                finally:
                    if used:
                        used(result)
                begin()
        finally:
            for f in open_:
                if not f.cancel() and f.exception() is None and used:
                    used(f.result())


_END = object()


def decoded(items: Iterable[X], most: int) -> Iterator[X]:
    """``items``, produced by a thread that keeps at most ``most`` ready; 0: without one.

    An error of the producer is raised behind the items before it. A reader that stops ends the thread.
    """
    if most < 0:
        raise ValueError("most can't be negative")
    if not most:
        yield from items
        return
    ready: queue.Queue = queue.Queue(most)
    stop = threading.Event()

    def put(x) -> bool:
        while not stop.is_set():
            try:
                ready.put(x, timeout=0.05)
                return True
            except queue.Full:
                continue
        return False

    def produce() -> None:
        end = (_END, None)
        try:
            for x in items:
                if not put((None, x)):
                    return
        except BaseException as error:  # the reader raises it
            end = (_END, error)
        put(end)

    thread = threading.Thread(target=produce, daemon=True)
    thread.start()
    try:
        while True:
            mark, x = ready.get()
            if mark is _END:
                if x is not None:
                    raise x
                return
            yield x
    finally:
        stop.set()
        thread.join()
