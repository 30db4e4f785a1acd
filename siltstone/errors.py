"""Exceptions of the engine, one family for each layer."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all. ``message`` is a fixed text, or a format for the arguments."""

    message = "Engine error"

    def __init__(self, *details: object):
        self.details = details
        super().__init__(self.message.format(*details) if details else self.message)


class TableError(EngineError):
    message = "Table error"


class CapacityExceeded(TableError):
    message = "Memtable capacity exceeded"


class KeyNotFound(TableError, KeyError):
    message = "Key not found in memtable"

    def __str__(self) -> str:
        return self.args[0]


class InvalidOperation(TableError):
    message = "Invalid operation: {}"


class IndexKeyNotFound(KeyNotFound):
    message = "Key not found in index"


class LogError(EngineError):
    message = "WAL I/O error: {}"


class InvalidRecord(LogError):
    message = "Invalid WAL record format"


class CheckpointNotFound(LogError):
    message = "Checkpoint not found"


class DurabilityError(EngineError):
    message = "Durability error: {}"


class IntegrityCheckFailed(DurabilityError):
    message = "Segment integrity check failed: {}"


class RecoveryFailed(DurabilityError):
    message = "Recovery failed: {}"


class DataCorruption(DurabilityError):
    message = "Data corruption detected: {}"


class TransactionError(DurabilityError):
    message = "Transaction error: {}"


class TransactionAlreadyExists(TransactionError):
    message = "Transaction already exists: {}"


class TransactionNotFound(TransactionError):
    message = "Transaction not found: {}"


class TransactionWrongState(TransactionError):
    message = "Transaction {} in wrong state: {}"


class TransactionNotPrepared(TransactionError):
    message = "Transaction not prepared: {}"


class TransactionAlreadyPrepared(TransactionError):
    message = "Transaction already prepared: {}"


class TransactionAlreadyCommitted(TransactionError):
    message = "Transaction already committed: {}"


class TransactionAlreadyAborted(TransactionError):
    message = "Transaction already aborted: {}"
