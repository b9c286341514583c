"""License templates in the markup of license lists.

``<<beginOptional>>...<<endOptional>>`` may be left out; ``<<var;min=0;max=12>>``
stands for so many words of any kind. Only words count: case, punctuation and line
breaks don't. The wording is that of the licenses and of their usual notices.
"""

#: (label, template). Fixed values.
TEMPLATES = (
    ("apache-2.0", "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, Version 2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;min=0;max=12>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("mit", "<<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;min=1;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<var;min=0;max=4>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<var;min=0;max=4>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    ("gpl", "GNU General Public License<<beginOptional>>,<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;min=1;max=2>>"),
    ("gpl-3.0", "GNU General Public License, <<beginOptional>>either<<endOptional>> version 3"),
    ("gpl-2.0", "GNU General Public License, <<beginOptional>>either<<endOptional>> version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "<<beginOptional>>Licensed under<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc0-1.0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
