"""A resumable automaton that splits chunks of text at thinking and tool markers.

Every character is looked at once, however a text is cut into chunks: between chunks only the mode and the last few
characters that may begin a marker stay, and what lies inside an open block goes to a store in pieces that aren't read again
before the block closes. The state of a stream processor can be such a store.
"""
from collections.abc import Callable
from dataclasses import dataclass, field

PIECE = 1 << 14  # characters that are held together before they go to the store


@dataclass
class MemoryStore:
    """Pieces of open blocks by block and number."""

    pieces: dict = field(default_factory=dict)

    def put(self, block: str, number: int, text: str) -> None:
        self.pieces[block, number] = text

    def take(self, block: str, count: int) -> list:
        """The first `count` pieces of a block, which is empty afterwards."""
        return [self.pieces.pop((block, n)) for n in range(count)]


@dataclass
class Markers:
    """mode: text, tool, think, or call (a tool block inside thinking); tail: what may begin a marker.

    `open_think` and `open_tool` hold the end of an open block, `n_think` and `n_tool` say how many pieces the store has of it.
    """

    think: tuple
    tool: tuple
    mode: str = "text"
    tail: str = ""
    open_think: str = ""
    open_tool: str = ""
    n_think: int = 0
    n_tool: int = 0

    def _watched(self) -> list:
        """Markers that end the present mode."""
        return {"text": [self.think[0], self.tool[0]], "tool": [self.tool[1]], "think": [self.think[1], self.tool[0]], "call": [self.think[1], self.tool[1]]}[self.mode]

    def _hold(self, store, block: str, text: str) -> None:
        held = getattr(self, f"open_{block}") + text
        if len(held) > PIECE:
            store.put(block, getattr(self, f"n_{block}"), held)
            setattr(self, f"n_{block}", getattr(self, f"n_{block}") + 1)
            held = ""
        setattr(self, f"open_{block}", held)

    def _release(self, store, block: str) -> str:
        whole = "".join(store.take(block, getattr(self, f"n_{block}"))) + getattr(self, f"open_{block}")
        setattr(self, f"open_{block}", "")
        setattr(self, f"n_{block}", 0)
        return whole

    def _pass(self, store, text: str, said: Callable) -> None:
        """Text inside the present mode."""
        if self.mode == "text":
            said("text", text)
        else:
            self._hold(store, "think" if self.mode == "think" else "tool", text)

    def _meet(self, store, marker: str, said: Callable) -> None:
        """Change the mode at a marker."""
        if self.mode == "text":
            self.mode = "think" if marker == self.think[0] else "tool"
        elif self.mode == "tool":
            said("call", self._release(store, "tool"))
            self.mode = "text"
        elif marker == self.think[1]:  # thinking ends, and with it a tool block that wasn't closed inside
            self._release(store, "think")
            self._release(store, "tool")
            self.mode = "text"
        elif self.mode == "think":
            self.mode = "call"
        else:
            said("call", self._release(store, "tool"))
            self.mode = "think"

    def feed(self, store, chunk: str, said: Callable) -> None:
        """Take the next chunk; said(kind, text) gets what is certain."""
        text, at = self.tail + chunk, 0
        while True:
            found = min(((p, m) for m in self._watched() if (p := text.find(m, at)) >= 0), default=None)
            if found is None:
                break
            if found[0] > at:
                self._pass(store, text[at:found[0]], said)
            self._meet(store, found[1], said)
            at = found[0] + len(found[1])
        keep = max((n for m in self._watched() for n in range(1, min(len(m), len(text) - at + 1)) if text.endswith(m[:n])), default=0)
        if len(text) - keep > at:
            self._pass(store, text[at:len(text) - keep], said)
        self.tail = text[len(text) - keep:]

    def finish(self, store, said: Callable) -> None:
        """The input ends: an open call counts as closed, thinking without an end is text."""
        if self.tail:
            self._pass(store, self.tail, said)
        if self.mode == "tool":
            said("call", self._release(store, "tool"))
        elif self.mode in ("think", "call"):
            inner = self.tool[0] + self._release(store, "tool") if self.mode == "call" else ""
            said("text", self.think[0] + self._release(store, "think") + inner)
        self.mode, self.tail = "text", ""
