from rowloom.functions.scalar import ZERO_TOLERANCE, checked_product, is_zero, not_zero

__all__ = ["ZERO_TOLERANCE", "checked_product", "is_zero", "not_zero"]
