"""Operations for preparing text at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` registers them.
"""
