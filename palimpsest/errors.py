"""Errors of the engine. A key that is missing is no error: reads return None or no row."""


class EngineError(Exception):
    """Base of all errors below."""


class RunError(EngineError):
    """Errors of a sorted run."""


class CapacityExceeded(RunError):
    """The rows would exceed the run's byte limit."""


class RunFrozen(RunError):
    """The run takes no more writes."""


class BlockError(EngineError):
    """Errors of slotted blocks."""


class CorruptBlock(BlockError):
    """The bytes are no block."""


class BlockFull(BlockError):
    """The entry does not fit beside the others."""


class EntryTooLarge(BlockError):
    """The entry fits no block."""


class JournalError(EngineError):
    """Errors of journal entries."""


class EntryTooShort(JournalError):
    """The bytes end before the entry does."""


class InvalidEntryType(JournalError):
    """The entry's type is none of the known ones."""


class EntryExceedsJournal(JournalError):
    """The entry is longer than the journal's capacity."""


class SegmentError(EngineError):
    """Errors of segments."""


class SegmentFull(SegmentError):
    """The segment has no block left."""


class InvalidSegmentSize(SegmentError):
    """The size is no multiple of a block."""


class ExtentError(EngineError):
    """Errors of the extent store."""


class InvalidHeader(ExtentError):
    """The manifest is missing or of another format."""


class ExtentNotFound(ExtentError):
    """There is no extent of that id."""


class AlreadyOpen(ExtentError):
    """The extent is open already."""


class AlreadyClosed(ExtentError):
    """The handle is closed."""


class StillOpen(ExtentError):
    """The extent is open and cannot be deleted."""


class StorageExhausted(ExtentError):
    """All free space together is smaller than the request."""


class FragmentationLimit(ExtentError):
    """There is space enough, but no single range is large enough."""


class InsufficientSpace(ExtentError):
    """The store is too small for its own regions."""


class ReadOutOfBounds(ExtentError):
    """A read reaches beyond the extent."""


class WriteOutOfBounds(ExtentError):
    """A write reaches beyond the extent."""


class InvalidRow(EngineError):
    """A row breaks the model: namespace below 0, version time not above 0, or a null key."""


class StaleManifest(EngineError):
    """Another writer committed first."""
