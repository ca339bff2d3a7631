"""subtide.functions"""
