"""Tables written between the steps of one operator: the package's own."""

from ..scratch import drop, folder, keep, tidy

__all__ = ["drop", "folder", "keep", "tidy"]
