"""Errors of the public interface; all are ValueErrors."""


class EngineError(ValueError):
    """Base of all errors that the engine raises on purpose."""


class CollectionNotFound(EngineError):
    def __init__(self, name: str):
        super().__init__(f"collection '{name}' not found")


class CollectionAlreadyExists(EngineError):
    def __init__(self, name: str):
        super().__init__(f"collection '{name}' already exists")


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")


class DocumentNotFound(EngineError):
    def __init__(self, id: str):
        super().__init__(f"document '{id}' not found")


class EmptyVector(EngineError):
    def __init__(self):
        super().__init__("empty vector provided")


class InvalidFilter(EngineError):
    def __init__(self, why: str):
        super().__init__(f"invalid filter: {why}")


class StorageError(EngineError):
    """A file of a collection is missing, damaged or of an unknown kind."""


class SerializationError(EngineError):
    """A value has no JSON form."""


class InternalError(EngineError):
    """Arguments that do not fit together."""
