from tallyfold.plans.units import units_by_brand_month

__all__ = ["units_by_brand_month"]
