"""docquarry: document-style queries over typed, time-indexed collections, on Spark."""

__version__ = "0.1.0"

from docquarry.plans.collection import Collection, accelerate
from docquarry.plans.cursor import Cursor
from docquarry.schema import Schema
from docquarry.types import Any, Bool, DateTime, Float, Int, List, ObjectId, String, Struct, Timestamp

__all__ = ["Any", "Bool", "Collection", "Cursor", "DateTime", "Float", "Int", "List", "ObjectId", "Schema", "String", "Struct", "Timestamp", "accelerate"]
