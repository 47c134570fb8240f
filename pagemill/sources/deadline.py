"""Time limits of engines: calls run in a child process that is ended when one takes too long, so that a hostile file costs its own time alone."""

from __future__ import annotations

import multiprocessing
import os
import signal
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from multiprocessing.connection import wait
from pathlib import Path
from typing import Any

#: Seconds after which a child whose parent is gone ends by itself.
GRACE = 2.0
#: Seconds after which it is looked whether a call computes or only waits, and how many that wait a task leaves aside while it goes on.
PATIENCE, ASIDE = 0.05, 8
#: The callers' ends of pipes to children; a child closes what it got of them, so that no other child's pipe stays open by it.
_OPEN: set = set()


class Overdue(TimeoutError):
    """A call that was ended because its time was up."""


class Failed(RuntimeError):
    """What a called function raised, or how its process ended."""


def _serve(pipe, functions: Mapping[str, Callable]) -> None:
    """Calls functions by name until the pipe ends. Its own alarm ends the process even where no one waits for it any more, and in foreign code, too."""
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    for other in _OPEN:
        other.close()
    _OPEN.clear()
    while True:
        try:
            name, args, seconds = pipe.recv()
        except EOFError:
            return
        if seconds is not None:
            signal.setitimer(signal.ITIMER_REAL, seconds + GRACE)
        began = time.monotonic()
        try:
            told = (functions[name](*args), None)
        except Exception as e:
            told = (None, str(e) or type(e).__name__)
        signal.setitimer(signal.ITIMER_REAL, 0)
        told = (*told, time.monotonic() - began)
        try:
            pipe.send(told)
        except OSError:
            return


class Guard:
    """Functions of a task, each call with a time limit. One child serves call after call; after one that was ended, the next call gets a new one.

    The child is forked, so functions needn't be sent; they get and give what can be pickled. Without a limit a function is called as it is.
    """

    def __init__(self, functions: Mapping[str, Callable]):
        self.functions, self.child, self.pipe = functions, None, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        _OPEN.add(self.pipe)
        self.child = context.Process(target=_serve, args=(other, self.functions), daemon=True)
        self.child.start()
        other.close()

    def call(self, name: str, *args: Any, seconds: float | None = None) -> Any:
        """The function's result; Overdue when it isn't there after so many seconds, Failed when it raised or its process ended."""
        if seconds is None:
            try:
                return self.functions[name](*args)
            except Exception as e:
                raise Failed(str(e) or type(e).__name__) from e
        self.begin(name, *args, seconds=seconds)
        return self.answer()

    def begin(self, name: str, *args: Any, seconds: float) -> None:
        """Asks the child for the function's result, without waiting for it."""
        if self.child is None:
            self._start()
        self.asked = (name, seconds, time.monotonic(), _cpu_seconds(self.child.pid))
        try:
            self.pipe.send((name, args, seconds))
        except (BrokenPipeError, ConnectionResetError):
            pass  # the answer tells how it ended

    def left(self) -> float:
        """Seconds until the time of what was asked is up."""
        return max(0.0, self.asked[2] + self.asked[1] - time.monotonic())

    def waits(self) -> bool:
        """Whether the child computed less than half of the time since it was asked, nor has a process that may compute for it; no if that can't be told."""
        now, then = _cpu_seconds(self.child.pid), self.asked[3]
        return now is not None and then is not None and now - then < (time.monotonic() - self.asked[2]) / 2

    def answer(self) -> Any:
        """The result of what was asked, waited for until its time is up."""
        name, seconds, *_ = self.asked
        try:
            if not self.pipe.poll(self.left()):
                self.end()
                raise Overdue(f"{name} took more than {seconds:g} seconds")
            value, error, took = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError) as e:
            self.child.join(GRACE)
            code = self.child.exitcode
            self.end()
            if code == -signal.SIGALRM:  # by its own alarm, before it was looked at
                raise Overdue(f"{name} took more than {seconds:g} seconds") from e
            raise Failed(f"the process of {name} ended with {code}") from e
        if took > seconds:
            raise Overdue(f"{name} took more than {seconds:g} seconds")
        if error is not None:
            raise Failed(error)
        return value

    def end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.child.close()
            _OPEN.discard(self.pipe)
            self.pipe.close()
            self.child = self.pipe = None

    def __enter__(self) -> Guard:
        return self

    def __exit__(self, *_: Any) -> None:
        self.end()


def _cpu_seconds(pid: int) -> float | None:
    """CPU seconds of a process so far; None if it has processes of its own or the system doesn't tell."""
    try:
        if Path(f"/proc/{pid}/task/{pid}/children").read_text().strip():
            return None
        user, system = Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[11:13]
        return (int(user) + int(system)) / os.sysconf("SC_CLK_TCK")
    except (OSError, ValueError):
        return None


def overlapped(functions: Mapping[str, Callable], calls: Iterable[tuple[Any, str, tuple, float | None]], aside: int = ASIDE) -> Iterator[tuple[Any, Any, Exception | None]]:
    """(tag, value, error) of calls (tag, name, args, seconds), each as Guard.call has it, not always in their order.

    One call computes at a time. A call that only waits is left aside, so many at most, and the next begins in another child; so files that hang
    their engines wait for the end of their time together. One left aside that begins to compute later shares the core. Calls without a limit are made here.
    """
    free: list[Guard] = []
    waiting: list[tuple[Any, Guard]] = []

    def outcome(tag: Any, guard: Guard) -> tuple[Any, Any, Exception | None]:
        free.append(guard)
        try:
            return tag, guard.answer(), None
        except (Overdue, Failed) as e:
            return tag, None, e

    def done() -> Iterator[tuple[Any, Any, Exception | None]]:
        for one in [w for w in waiting if w[1].pipe.poll() or not w[1].left()]:
            waiting.remove(one)
            yield outcome(*one)

    guard = None
    try:
        for tag, name, args, seconds in calls:
            guard = free.pop() if free else Guard(functions)
            if seconds is None:
                free.append(guard)
                try:
                    yield tag, guard.call(name, *args), None
                except Failed as e:
                    yield tag, None, e
                continue
            guard.begin(name, *args, seconds=seconds)
            while not guard.pipe.poll(min(PATIENCE, guard.left())) and guard.left():
                yield from done()
                if len(waiting) < aside and guard.waits():
                    waiting.append((tag, guard))
                    break
            else:
                yield outcome(tag, guard)
            guard = None
            yield from done()
        while waiting:
            wait([g.pipe for _, g in waiting], min(g.left() for _, g in waiting))
            yield from done()
    finally:
        for g in [*free, *(g for _, g in waiting), *([guard] if guard else [])]:
            g.end()
