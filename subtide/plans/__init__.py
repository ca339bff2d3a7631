"""subtide.plans"""
