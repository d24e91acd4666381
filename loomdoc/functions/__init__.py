"""loomdoc.functions"""
